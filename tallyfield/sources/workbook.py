"""Workbooks (.xlsx) as Spark jobs, with the standard library alone.

    read_workbooks(spark, "/data/basket.xlsx", "basket")

A workbook's first matching sheet is read. One task for each workbook inflates it, once from end to end, and cuts its XML into ranges of
whole rows; a range takes along the layout of its sheet and the shared strings that it names, so ranges need nothing but
themselves, are dealt out to all tasks, and are parsed there. Work grows with the bytes of the sheets. For flat kinds the header row is
the one among the first thirty with most known headers, and columns bind by header text; the ledger's header has two levels, and columns
bind by both. All cells are text, as written or as the formula's cached result; an error cell is null and named in `bad_cells`. A row with
a total's label, and without what numbers or dates a row of its kind, is given back as a footer. Parsing of numbers and dates is left to
column expressions, so that it runs in the JVM.

`spark.read.format("workbook").option("kind", "basket")`, after registering WorkbookSource, gives the same rows with a map of fields. Its
tasks, of PART_BYTES or of fewer where the option `tasks` names more of them, share no data, so each inflates the sheet up to its own rows.
"""

from __future__ import annotations

import os
import pickle
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import takewhile
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.numbers import number
from ..functions.text import clean

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_ROW, _VALUE, _INLINE, _STRING = f"{_MAIN}row", f"{_MAIN}v", f"{_MAIN}is", f"{_MAIN}si"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
HEADER_ROWS = 30
WIDE_MERGE = 10
#: Bytes of workbooks, as they lie there, whose ranges a task parses at most and, where there are tasks to spare, at least.
SHARE_BYTES, LEAST_SHARE_BYTES = 2 * 2**20, 2**18
#: Bytes of XML that are inflated at a time: about what a range holds.
BLOCK_BYTES = 2**20
#: Bytes of a sheet's XML that a task of the data source reads at most and, where there are tasks to spare, at least.
PART_BYTES, LEAST_PART_BYTES = 16 * 2**20, 4 * 2**20
# Labels of totals rows, headers of the column that numbers rows, and the header over the farmers' names.
TOTALS = re.compile(r"^\s*(жами|итого|всего|хаммаси|jami|total)\s*:?\s*$", re.I)
ROW_NUMBER = re.compile(r"^(№|n\s*/\s*p|t\s*/\s*r|#)$", re.I)
FARMER_HEADER = re.compile(r"хужалик номи|хўжалик номи|фермер номи", re.I)
# What a row of each kind has and a totals row has not; the row's number where nothing is named.
NUMBERED_BY = {"payments": "op_datetime", "accounts": "account", "shipments": "deal_number"}
# The ledger's columns as (field, zone, leaf); a leaf of digits is the column's place under its zone.
LEDGER = (
    ("farmer_name", "хўжалик номи", None), ("farmer_inn", "хўжалик иннси", None), ("farmer_region", "вилояти", None), ("farmer_district", "тумани", None),
    ("contract_type", "шартнома тури", None), ("contract_number", "шартнома раками", None), ("contract_qty", "шартнома миқдори", None),
    ("acceptance_date", "кабул қилиш", "санаси"), ("acceptance_record_no", "кабул қилиш", "кайд раками"), ("pk17_number", "пк-17 раками", None),
    ("pk17_registered_at", "пк-17 имзолаш холати", "1"), ("pk17_signed_at", "пк-17 имзолаш холати", "2"),
    ("batch_no", "партия", None), ("plot_type", "жойлашуви", "жой тури"), ("plot_no", "жойлашуви", "жой раками"),
    ("variety_declared", "пахтанинг тури (партия бўйича)", "селекцион нави"), ("generation_declared", "пахтанинг тури (партия бўйича)", "авлоди"),
    ("industrial_grade_declared", "пахтанинг тури (партия бўйича)", "саноат нави"), ("class_declared", "пахтанинг тури (партия бўйича)", "синфи"),
    ("picking_method", "терим услуби", None), ("lab_2hl_number", "лаборатория хулосаси", "2-хл раками"),
    ("industrial_grade_lab", "лаборатория хулосаси", "саноат нави"), ("class_lab", "лаборатория хулосаси", "синфи"),
    ("gross_kg", "брутто кг", None), ("tare_kg", "тара кг", None), ("physical_kg", "физик вазни кг", None), ("impurity_pct", "ифлослиги %", None),
    ("calculated_kg", "хисобий вазни кг", None), ("moisture_pct", "намлиги %", None), ("conditioned_kg", "кондицион вазни кг", None),
    ("markup", "устама", None), ("discount", "чегирма", None), ("unit_price", "харид баҳоси кг/сўм", None), ("amount", "суммаси сўм", None),
    ("transport_fee", "кўшимча тўловлар сўм", "ташиб келтириш"), ("seed_cotton_fee", "кўшимча тўловлар сўм", "уруғлик пахта учун"),
    ("other_fee_total", "кўшимча тўловлар сўм", "жами қўшимча"), ("buyer_name", "сотиб олувчи", None), ("buyer_inn", "сотиб олувчи инн", None),
    ("preparation_point_name", "тайерлов маскани номи", None), ("preparation_district", "туман", None), ("preparation_region", "вилоят", None),
    ("vehicle_type", "транспорт", "тури"), ("vehicle_plate", "транспорт", "давлат ракам белгиси"),
    ("trailer_count", "тиркама", "сони"), ("trailer_plate", "тиркама", "давлат ракам белгилари"), ("cluster_name", "кластер", None),
)
# Columns of each kind of workbook, by the headers that may stand over them.
KINDS: dict[str, dict[str, tuple[str, ...]]] = {
    "basket": {
        "farmer_name": ("хўжалик номи", "farmer"), "tax_id": ("хўжалик иннси", "tax id"), "region": ("вилоят", "region"), "district": ("туман", "district"),
        "contract_type": ("шартнома тури", "contract type"), "contract_number": ("шартнома рақами", "contract"), "contract_qty": ("шартнома миқдори", "contract qty"),
        "acceptance_date": ("қабул қилиш санаси", "acceptance date"), "record_no": ("далолатнома рақами", "record"), "pk17_number": ("пк-17 рақами", "pk17"),
        "method": ("терим услуби", "method"), "physical_kg": ("физик вазни", "physical kg"), "conditioned_kg": ("кондицион вазни", "conditioned kg"),
        "unit_price": ("нархи", "price"), "amount": ("суммаси", "amount"), "buyer_name": ("сотиб олувчи", "buyer"),
    },
    "payments": {
        "tx_id": ("id транзакции", "transaction id"), "attributes": ("атрибуты", "attributes"), "op_datetime": ("дата операции", "date"),
        "counterparty_name": ("контрагент", "counterparty"), "counterparty_inn": ("инн контрагента", "counterparty id"),
        "counterparty_account": ("счет контрагента", "counterparty account"), "account_name": ("наименование счета", "account name"),
        "debit": ("дебет", "debit"), "credit": ("кредит", "credit"), "details": ("назначение", "details"),
    },
    "accounts": {
        "no": ("№", "no"), "bank_account": ("счет ркп", "bank account"), "account_name": ("название счета", "account name"), "account": ("лицевой счет", "account"),
        "balance": ("баланс", "balance"), "is_default": ("по умолчанию", "default"), "holder_inn": ("инн клиента", "holder id"), "holder_name": ("клиент", "holder"),
    },
    "shipments": {
        "deal_number": ("номер сделки", "deal"), "deal_date": ("дата сделки", "deal date"), "clearing_contract": ("номер контракта", "contract"),
        "seller_name": ("продавец", "seller"), "buyer_name": ("покупатель", "buyer"), "product_name": ("товар", "product"),
        "document_number": ("номер документа", "document"), "document_date": ("дата документа", "document date"), "shipment_qty": ("кол-во отгрузки", "shipment qty"),
        "delivery_cost": ("стоимость поставки", "delivery cost"), "deal_qty": ("кол-во сделки", "deal qty"), "deal_amount": ("сумма сделки", "deal amount"),
        "unit": ("ед. изм", "unit"), "status": ("статус", "status"),
    },
    "directory": {
        "ord": ("тартиб", "order"), "display_name": ("номи", "display name"), "section": ("бўлим", "section"), "region_block": ("ҳудуд", "region block"), "tax_id": ("инн", "tax id"),
        "plan_t": ("режа", "plan"), "basket_name": ("basket name"),
    },
}
# Marks of each kind in a file's name, and texts that its sheets hold all of.
NAME_MARKS = {"basket": "basket|саватда", "payments": "выписк|vypisk|statement", "accounts": r"лицев\w*[\s_]*сч|ркп[\s_]*сч|accounts?", "shipments": "shipments?|отгрузк"}
CONTENT_MARKS = {"basket": ("хўжалик иннси", "терим услуби"), "payments": ("id транзакции", "дебет", "кредит"), "accounts": ("счет ркп", "баланс"), "shipments": ("номер сделки", "кол-во отгрузки")}
REQUIRED = {"basket": ("farmer_name", "conditioned_kg"), "payments": ("debit", "credit"), "accounts": ("balance",), "shipments": ("deal_number",), "directory": ("display_name",)}


class MissingColumns(ValueError):
    """A workbook lacks columns that its kind needs; the message lists what was found."""


def header_key(text: str | None) -> str:
    """As the column function of that name does it, for headers in the reader."""
    plain = re.sub(r"[\s ]+", " ", text or "").strip().lower().replace("ё", "е")
    return re.sub(r"\s+", " ", re.sub(r'[.,:;()"«»№#]', " ", plain)).strip() or plain


def ledger_key(text: str | None) -> str:
    """As the column function ledger_header_key does it."""
    plain = re.sub(r"[\s\u00a0]+", " ", text or "").strip().lower().replace("ё", "е")
    return re.sub(r"\s+", " ", re.sub("[.,;:]", "", plain)).strip()


def column_index(ref: str) -> int:
    """A1-style letters as a number from 0."""
    n = 0
    for c in re.match("[A-Z]+", ref).group():  # type: ignore[union-attr]
        n = n * 26 + ord(c) - 64
    return n - 1


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; a bare path is one that all tasks see."""
    return (fs.LocalFileSystem(), path.removeprefix("file://").removeprefix("file:")) if path.startswith("file:") or "://" not in path else fs.FileSystem.from_uri(path)


def listed(path: str) -> list[str]:
    """The .xlsx files that path names: a folder, a pattern with * in its last part, or one file."""
    store, place = _store(path)
    folder, _, last = place.rpartition("/")
    found = store.get_file_info(place)
    if found.type == fs.FileType.Directory:
        folder, last = place, "*.xlsx"
    elif found.type == fs.FileType.File:
        return [path]
    pattern = re.compile(".*".join(map(re.escape, last.split("*"))) + "$")
    head = path[: len(path) - len(place)]
    try:
        inside = store.get_file_info(fs.FileSelector(folder))
    except FileNotFoundError:
        inside = []
    files = sorted(head + f.path for f in inside if f.type == fs.FileType.File and pattern.match(f.base_name))
    if not files:
        raise FileNotFoundError(path)
    return files


def _size(path: str) -> int:
    store, place = _store(path)
    return store.get_file_info(place).size or 0


#: A range of a workbook on its way to the task that parses it.
RANGE = pa.schema({"file": pa.string(), "kind": pa.string(), "layout": pa.binary(), "xml": pa.binary(), "numbers": pa.list_(pa.int32()), "strings": pa.list_(pa.string())})
Row = tuple[int, dict[int, str], list[int]]


def _text(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def _row(node: ElementTree.Element, columns: dict[str, int], strings: list[str] | dict[int, str]) -> Row:
    """A row's number, texts and error cells. columns: what the letters seen so far stand for."""
    cells, bad, digits = {}, [], len(node.get("r", ""))
    for n, c in enumerate(node):
        letters = c.get("r", "")[:-digits] if digits else ""
        at = columns.get(letters)
        if at is None:
            at = columns[letters] = column_index(letters) if letters else n
        for part in c:  # a formula may stand before its result
            tag = part.tag
            if tag == _VALUE:
                kind = c.get("t")
                if kind == "e":
                    bad.append(at)
                elif (text := strings[int(part.text)] if kind == "s" else part.text) is not None:
                    cells[at] = text
                break
            if tag == _INLINE:
                if text := part[0].text if len(part) == 1 else _text(part):
                    cells[at] = text
                break
    return int(node.get("r", 0)), cells, bad


def _rows_of(xml: bytes, columns: dict[str, int], strings: list[str] | dict[int, str]) -> Iterator[Row]:
    return (_row(node, columns, strings) for node in ElementTree.fromstring(xml) if node.tag == _ROW)


class Workbook:
    """Sheets of an .xlsx file as rows of text."""

    def __init__(self, path: str):
        store, place = _store(path)
        self.zip = zipfile.ZipFile(store.open_input_file(place))
        names = self.zip.namelist()
        self.strings = self._shared_strings("xl/sharedStrings.xml") if "xl/sharedStrings.xml" in names else []
        places = {r.get("Id"): r.get("Target") for r in self._xml("xl/_rels/workbook.xml.rels")}
        sheets = self._xml("xl/workbook.xml").find(f"{_MAIN}sheets")
        self.sheets = {s.get("name"): "xl/" + places[s.get(_REL)].removeprefix("/xl/") for s in sheets}
        self.columns: dict[str, int] = {}

    def _xml(self, name: str) -> ElementTree.Element:
        return ElementTree.fromstring(self.zip.read(name))

    def _shared_strings(self, name: str) -> list[str]:
        texts = []
        with self.zip.open(name) as f:
            for _, node in ElementTree.iterparse(f):
                if node.tag == _STRING:
                    texts.append(_text(node))
                    node.clear()
        return texts

    def size(self, sheet: str) -> int:
        """Bytes of a sheet's XML."""
        return self.zip.getinfo(self.sheets[sheet]).file_size

    def rows(self, sheet: str, low: int = 0, high: int | None = None) -> Iterator[Row]:
        """(row number, text by column, columns with errors) of the rows that begin in a range of the XML's bytes, read as a stream."""
        for xml in self.ranges(sheet, low, high):
            yield from _rows_of(xml, self.columns, self.strings)

    def named_strings(self, xml: bytes) -> dict[int, str]:
        """The shared strings that a range may name, by number: whatever value is the number of one."""
        if not self.strings:
            return {}
        numbers = np.unique(np.array(re.findall(rb">\s*(\d{1,9})\s*</(?:\w+:)?v>", xml), np.int64))
        return {n: self.strings[n] for n in numbers[numbers < len(self.strings)].tolist()}

    def ranges(self, sheet: str, low: int = 0, high: int | None = None) -> Iterator[bytes]:
        """The rows that begin in a range of the XML's bytes as documents of whole rows, about a block each, in one pass over the sheet."""
        with self.zip.open(self.sheets[sheet]) as f:
            held, at = f.read(BLOCK_BYTES), 0  # at: where held begins
            root = re.search(rb"<(?:(\w+):)?worksheet[^>]*>", held)
            if root is None:
                return
            mark = (root.group(1) + b":") if root.group(1) else b""
            tag, end = b"<" + mark + b"row", b"</" + mark + b"sheetData>"
            top, bottom = root.group(), b"</" + mark + b"worksheet>"
            started = False
            while True:
                last = held.find(end)
                if not started:
                    first = held.find(tag, max(0, low - at), None if last < 0 else last)
                    if first >= 0:
                        held, at, started, last = held[first:], at + first, True, last - first if last >= 0 else -1
                if started:
                    cut = held.find(tag, max(0, high - at)) if high is not None else -1
                    over = cut if 0 <= cut and (last < 0 or cut < last) else last
                    # without an end in sight, the last row that has begun waits for the next block
                    some = held[: over if over >= 0 else max(held.rfind(tag), 0)]
                    if some:
                        yield top + some + bottom
                    held, at = held[len(some) :], at + len(some)
                    if over >= 0:
                        return
                elif last >= 0:
                    return
                block = f.read(BLOCK_BYTES)
                if not block:
                    return
                if not started:  # a tag may lie across two blocks
                    keep = min(len(held), 64)
                    held, at = held[len(held) - keep :], at + len(held) - keep
                held += block

    def merges(self, sheet: str) -> list[tuple[int, int, int, int]]:
        """(first row, first column, last row, last column) of each merged range; they stand after the rows, which are passed over."""
        tail, seen = b"", False
        with self.zip.open(self.sheets[sheet]) as f:
            while block := f.read(BLOCK_BYTES):
                tail = (tail if seen else tail[-64:]) + block
                if not seen and b"sheetData>" in tail and (end := re.search(rb"</(?:\w+:)?sheetData>", tail)):
                    tail, seen = tail[end.end() :], True
        found = re.findall(r'<(?:\w+:)?mergeCell [^>]*?ref="([A-Z]+)(\d+):([A-Z]+)(\d+)"', tail.decode() if seen else "")
        return [(int(r0), column_index(c0), int(r1), column_index(c1)) for c0, r0, c1, r1 in found]

    def labelled(self, sheet: str, pattern: str, rows: int = 10) -> str | None:
        """The next text after a label in the first rows."""
        for number, cells, _ in self.rows(sheet):
            if number > rows:
                break
            ordered = sorted(cells)
            for i, c in enumerate(ordered):
                if re.search(pattern, cells[c], re.I) and i + 1 < len(ordered):
                    return cells[ordered[i + 1]]
        return None


@dataclass
class Layout:
    """Where a sheet's header ends, which field each column holds, and what was odd about it."""

    header: int = 0
    fields: dict[int, str] = field(default_factory=dict)
    unknown: list[str] = field(default_factory=list)
    number_column: int = 0
    notes: list[str] = field(default_factory=list)


def _head(book: Workbook, sheet: str) -> tuple[dict[int, dict[int, str]], dict[tuple[int, int], tuple[int, int, int, int]]]:
    """The first rows, with merged texts of up to WIDE_MERGE columns in all their cells, and the merge of each cell; wider ones are banners."""
    seen = {number: dict(cells) for number, cells, _ in takewhile(lambda row: row[0] <= HEADER_ROWS, book.rows(sheet))}
    merge_of = {}
    for merge in book.merges(sheet):
        r0, c0, r1, c1 = merge
        text = seen.get(r0, {}).get(c0)
        if r0 > HEADER_ROWS or c1 - c0 >= WIDE_MERGE:
            continue
        for r in range(r0, min(r1, HEADER_ROWS) + 1):
            for c in range(c0, c1 + 1):
                merge_of[r, c] = merge
                if text is not None:
                    seen.setdefault(r, {}).setdefault(c, text)
    return seen, merge_of


def bind(book: Workbook, sheet: str, kind: str) -> Layout:
    """The layout of a flat sheet: its header is the row with most known headers, the first of equals."""
    known = {header_key(a): field for field, names in KINDS[kind].items() for a in names}
    best = Layout()
    for number, cells in sorted(_head(book, sheet)[0].items()):
        fields: dict[int, str] = {}
        for c in sorted(cells):
            found = known.get(header_key(cells[c]))
            if found and found not in fields.values():
                fields[c] = found
        if len(fields) > len(best.fields):
            numbers = [c for c in sorted(cells) if ROW_NUMBER.match(cells[c].strip())]
            best = Layout(number, fields, [cells[c] for c in sorted(cells) if c not in fields], (numbers or [0])[0])
    lacking = [f for f in REQUIRED[kind] if f not in best.fields.values()]
    if lacking:
        raise MissingColumns(f"sheet {sheet!r} lacks {lacking}; found {sorted(set(best.fields.values()))}")
    return best


def bind_ledger(book: Workbook, sheet: str) -> Layout:
    """The layout of a ledger: the header over the farmers' names spans its levels; other columns bind by the first and last of theirs.

    Where several columns stand under one zone whose leaves are places, their leaves are not looked at: labels there are wrong at times.
    """
    head, merge_of = _head(book, sheet)
    place = next(((r, c) for r in sorted(head) if r <= 15 for c in sorted(head[r]) if FARMER_HEADER.search(head[r][c])), None)
    if place is None:
        raise MissingColumns(f"sheet {sheet!r} lacks the header over the farmers' names")
    merge = merge_of.get(place)
    top, bottom = (merge[0], merge[2]) if merge else (place[0], place[0])
    by_path = {(zone, leaf): name for name, zone, leaf in LEDGER}
    by_place = {zone for _, zone, leaf in LEDGER if leaf and leaf.isdigit()}
    out, count = Layout(bottom, notes=[] if merge else ["HEADER_BOUNDARY_GUESSED"]), {}
    for c in sorted({c for r in range(top, bottom + 1) for c in head.get(r, {})}):
        path = [ledger_key(head[r][c]) for r in range(top, bottom + 1) if head.get(r, {}).get(c, "").strip()]
        levels = [x for i, x in enumerate(path) if i == 0 or x != path[i - 1]]
        if not levels:
            continue
        if ROW_NUMBER.match(levels[0]):
            out.number_column = c
            continue
        zone, leaf = levels[0], levels[-1] if len(levels) > 1 else None
        if zone in by_place:
            count[zone] = count.get(zone, 0) + 1
            leaf = str(count[zone])
        name = by_path.get((zone, leaf))
        if name and name not in out.fields.values():
            out.fields[c] = name
        else:
            out.unknown.append(" / ".join(levels))
    if "farmer_name" not in out.fields.values():
        out.fields[place[1]] = "farmer_name"
    return out


# The header of a hand-made day report: farmers' names, planned tons, and a day over each block of columns.
DAY_HEADER = (re.compile("фермер", re.I), re.compile("режа", re.I))
DAY_LABEL = re.compile(r"^(\d{2})[,.](\d{2})[,.](\d{2,4})")
#: From a block's first column: where the tons of each method stand; header levels below the days.
DAY_METHODS = {"HAND": 0, "MACHINE": 2}
DAY_LEVELS = 3


def bind_days(book: Workbook, sheet: str) -> Layout:
    """The layout of a day report: its header names farmers and plan in the second and third column, and every block of columns begins under its day.

    A merged day stands over its whole block; only its first cell begins one.
    """
    head, merge_of = _head(book, sheet)
    top = next((r for r in sorted(head) if r <= 15 and all(p.search(head[r].get(c, "")) for c, p in enumerate(DAY_HEADER, 1))), None)
    if top is None:
        raise MissingColumns(f"sheet {sheet!r} lacks a header over farmers and plan")
    out = Layout(top + DAY_LEVELS, {0: "number", 1: "name", 2: "plan_t"})
    for c in sorted(c for c in head[top] if c > 2):
        label = DAY_LABEL.match(head[top][c].strip())
        if label and merge_of.get((top, c), (top, c))[:2] == (top, c):
            day, month, year = label.groups()
            date = f"{'20' if len(year) == 2 else ''}{year}-{month}-{day}"
            out.fields |= {c + shift: f"{date}|{method}" for method, shift in DAY_METHODS.items()}
    return out


BINDERS = {"ledger": bind_ledger, "days": bind_days}


def kind_of_name(name: str) -> str | None:
    """The one kind whose mark a file name bears; none or several: undecided."""
    low = os.path.basename(name).lower().replace("ё", "е")
    hits = [k for k, mark in NAME_MARKS.items() if re.search(mark, low)]
    return hits[0] if len(hits) == 1 else None


def kind_of_content(book: Workbook) -> str | None:
    """The one kind all of whose texts the first rows hold; a sheet of shipments' name settles it at once."""
    if any(header_key(s) == "shipments" for s in book.sheets):
        return "shipments"
    texts = " | ".join(header_key(t) for s in list(book.sheets)[:3] for _, cells, _ in takewhile(lambda row: row[0] <= 12, book.rows(s)) for t in cells.values())
    hits = [k for k, marks in CONTENT_MARKS.items() if all(header_key(m) in texts for m in marks)]
    return hits[0] if len(hits) == 1 else None


def _sheet_of(book: Workbook, path: str, kind: str) -> tuple[str, str]:
    kind = kind or kind_of_name(path) or kind_of_content(book) or ""
    if not kind:
        raise ValueError(f"{path}: the kind of workbook can't be told")
    return kind, next((s for s in book.sheets if header_key(s) == kind), next(iter(book.sheets)))


def _cut(path: str, kind: str, low: int = 0, high: int | None = None) -> Iterator[dict[str, object]]:
    """The ranges of a workbook's rows that begin between two bytes, each with all that parsing it takes."""
    book = Workbook(path)
    kind, sheet = _sheet_of(book, path, kind)
    layout = pickle.dumps(BINDERS[kind](book, sheet) if kind in BINDERS else bind(book, sheet, kind))
    for xml in book.ranges(sheet, low, high):
        strings = book.named_strings(xml)
        yield {"file": os.path.basename(path), "kind": kind, "layout": layout, "xml": xml, "numbers": list(strings), "strings": list(strings.values())}


def _parsed(part: dict[str, object], wide: list[str] | None) -> pa.RecordBatch:
    """The rows of a range as a batch; its fields as columns of the names in wide, or as a map."""
    layout, kind = pickle.loads(part["layout"]), part["kind"]
    fields = layout.fields
    at = {f: c for c, f in fields.items()}
    numbered = at.get(NUMBERED_BY.get(kind, ""), layout.number_column)
    labels = {layout.number_column, *sorted(fields)[:3], *[at[f] for f in ("farmer_name", "account_name", "counterparty_account", "tx_id") if f in at]} - (
        {numbered} if kind in NUMBERED_BY else set()
    )
    numbers, values, errors, kinds = [], [], [], []
    for number, cells, bad in _rows_of(part["xml"], {}, dict(zip(part["numbers"], part["strings"], strict=True))):
        if number <= layout.header:
            continue
        found = {fields[c]: text for c, text in cells.items() if c in fields}
        if not found:
            continue
        # what numbers a row is missing there, or is the label itself
        number_text = cells.get(numbered, "").strip()
        plain = not number_text or bool(TOTALS.match(number_text))
        numbers.append(number)
        values.append(found)
        errors.append([fields[c] for c in bad if c in fields])
        kinds.append("footer" if plain and any(TOTALS.match(cells.get(c, "")) for c in labels) else "data")
    n, texts = len(numbers), pa.list_(pa.string())
    if wide is None:
        ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
        keys, items = pa.array([k for v in values for k in v], pa.string()), pa.array([x for v in values for x in v.values()], pa.string())
        shown = {"values": pa.MapArray.from_arrays(pa.array(ends), keys, items)}
    else:
        shown = {f: pa.array([v.get(f) for v in values], pa.string()) for f in wide}
    columns = {
        "file": pa.array([part["file"]] * n, pa.string()), "kind": pa.array([kind] * n, pa.string()), "source_row": pa.array(numbers, pa.int32()), **shown,
        "bad_cells": pa.array(errors, texts), "unknown_headers": pa.array([layout.unknown] * n, texts), "row_kind": pa.array(kinds, pa.string()), "notes": pa.array([layout.notes] * n, texts),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


class _Part(InputPartition):
    def __init__(self, path: str, kind: str, low: int, high: int):
        self.path, self.kind, self.low, self.high = path, kind, low, high


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.kind, self.path, self.tasks = options.get("kind", ""), options["path"], int(options.get("tasks", 1))

    def partitions(self) -> list[_Part]:
        sheets = []
        for path in listed(self.path):
            book = Workbook(path)
            kind, sheet = _sheet_of(book, path, self.kind)
            sheets.append((path, kind, book.size(sheet)))
        share = -(-sum(size for *_, size in sheets) // self.tasks)
        step = min(PART_BYTES, max(LEAST_PART_BYTES, share))
        return [_Part(path, kind, low, low + step) for path, kind, size in sheets for low in range(0, size, step)]

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        return (_parsed(some, None) for some in _cut(part.path, part.kind, part.low, part.high))


def _schema(fields: str) -> str:
    return f"file string, kind string, source_row int, {fields}, bad_cells array<string>, unknown_headers array<string>, row_kind string, notes array<string>"


class WorkbookSource(DataSource):
    """Rows of workbooks: file, kind, source_row, values by field, fields with error cells, headers not known, data or footer, notes on the header."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return _schema("values map<string,string>")

    def reader(self, schema: object) -> _Reader:
        return _Reader(self.options)


def fields_of(kind: str) -> list[str]:
    return [name for name, _, _ in LEDGER] if kind == "ledger" else list(KINDS[kind])


def _read(spark: SparkSession, path: str, kind: str, wide: list[str] | None) -> DataFrame:
    """All rows of the workbooks that path names: a task for each workbook cuts it, and as many as their bytes ask for parse the ranges."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (pa.RecordBatch.from_pylist([part], RANGE) for batch in batches for path in batch.column(0).to_pylist() for part in _cut(path, kind))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (_parsed(part, wide) for batch in batches for i in range(batch.num_rows) for part in batch.slice(i, 1).to_pylist())

    files, spare = listed(path), spark.sparkContext.defaultParallelism
    total = sum(_size(f) for f in files)
    share = min(SHARE_BYTES, max(LEAST_SHARE_BYTES, -(-total // spare)))
    named = spark.createDataFrame([(f,) for f in files], "path string")
    each = named.coalesce(1) if len(files) == 1 else named.repartition(len(files))
    ranges = each.mapInArrow(cut, "file string, kind string, layout binary, xml binary, numbers array<int>, strings array<string>")
    fields = "values map<string,string>" if wide is None else ", ".join(f"{f} string" for f in wide)
    return ranges.repartition(max(1, -(-total // share))).mapInArrow(parse, _schema(fields))


def read_rows(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """All rows of one kind of workbook, footers among them, with a column for each of its fields."""
    return _read(spark, path, kind, fields_of(kind)).drop("kind")


def read_workbooks(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The rows of one kind of workbook with a column for each of its fields."""
    return read_rows(spark, path, kind).where("row_kind = 'data'").drop("row_kind", "notes")


def statement_meta(path: str) -> dict[str, str | None]:
    """What stands above a statement's rows: the client's id, the account and the period."""
    book = Workbook(path)
    sheet = next(iter(book.sheets))
    client = book.labelled(sheet, r"^клиент\s+инн|^client id")
    text = " ".join(t for _, cells, _ in takewhile(lambda row: row[0] <= 10, book.rows(sheet)) for t in cells.values())
    # How a statement names its account and its period.
    found = {k: re.search(p, text, re.I) for k, p in {"account": r"лиц\.?\s*сч[её]т\s+клиента\s*:\s*(\d+)", "period_from": r"от\s*:\s*([\d.]+)", "period_to": r"до\s*:\s*([\d.]+)"}.items()}
    return {"client_inn": re.sub(r"\s", "", client) if client else None} | {k: m.group(1) if m else None for k, m in found.items()}


def classify_names(files: DataFrame, column: str = "file_name") -> DataFrame:
    """files with kind: the one whose mark the name bears, else null."""
    low = F.translate(F.lower(column), "ё", "е")
    hits = F.array_compact(F.array(*[F.when(low.rlike(f"(?U){mark}"), kind) for kind, mark in NAME_MARKS.items()]))
    return files.withColumn("kind", F.when(F.size(hits) == 1, hits[0]))


def unpivot_days(report: DataFrame, fixed: list[str], days: list[str]) -> DataFrame:
    """A hand-made wide report, with columns `<day>|<method>`, as rows of day, method and kg."""
    long = report.unpivot(fixed, days, "block", "kg")
    parts = F.split("block", r"\|")
    return long.where("kg is not null").select(*fixed, F.try_to_date(parts[0], "yyyy-MM-dd").alias("day"), parts[1].alias("method"), "kg")


# How a day report marks totals, the end of a section of several places, and places.
DAY_TOTAL, SECTION_END, NO_END, PLACE = "жами|хаммаси", "худуди жами|ҳудуди жами", "^ҳудуд жами", "(ҳудуди|худуди)$"


def read_day_report(spark: SparkSession, path: str, first_section: str = "") -> DataFrame:
    """(file, source_row, section, block, name, plan_t, day, method, kg) of hand-made day reports: a row for each farmer, day and method with a weight.

    A row with a number is a farmer's. Rows without one are totals, a place, or the name of a section; a place without a section
    before it belongs to first_section, and a section of several places ends at its total. Weights stand in tons.
    """
    rows = _read(spark, path, "days", None)
    name = clean(F.try_element_at("values", F.lit("name")))
    named = rows.select("file", "source_row", "values", name.alias("name"), number(F.try_element_at("values", F.lit("number"))).isNotNull().alias("numbered")).where("name <> ''")
    low = F.lower("name")
    total = low.rlike(DAY_TOTAL)
    kind = F.when(total, F.when(low.rlike(SECTION_END) & ~low.rlike(NO_END), "end")).when(~F.col("numbered"), F.when(low.rlike(PLACE), "place").otherwise("section"))
    marked = named.withColumn("kind", kind).withColumn("total", total)
    # a sheet's rows, in their order; a workbook has a million at most
    before = Window.partitionBy("file").orderBy("source_row").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda test, value: F.last(F.when(test, value), ignorenulls=True).over(before)
    opened = last(F.col("kind").isin("section", "end"), F.struct("source_row", F.when(F.col("kind") == "section", F.col("name")).otherwise("").alias("name")))
    placed = marked.withColumns({"opened": opened, "place": last(F.col("kind") == "place", F.col("source_row")), "block": F.coalesce(last(F.col("kind").isin("place", "section"), F.col("name")), F.lit(""))})
    implied = F.when(F.col("place") > F.coalesce("opened.source_row", F.lit(0)), first_section).otherwise("")
    section = F.when(F.coalesce("opened.name", F.lit("")) != "", F.col("opened.name")).otherwise(implied)
    farmers = placed.withColumn("section", section).where("numbered and not total")
    either = lambda a, b: F.when(F.col(a) != "", F.col(a)).otherwise(F.col(b))
    cells = farmers.select(
        "file", "source_row", either("section", "block").alias("section"), either("block", "section").alias("block"), "name",
        number(F.try_element_at("values", F.lit("plan_t"))).alias("plan_t"), F.explode("values").alias("at", "text"),
    ).where(F.col("at").contains("|"))
    parts = F.split("at", r"\|")
    kg = F.round(number(F.col("text")) * 1000, 0).cast("long")
    return cells.select("file", "source_row", "section", "block", "name", "plan_t", parts[0].cast("date").alias("day"), parts[1].alias("method"), kg.alias("kg")).where("kg is not null")
