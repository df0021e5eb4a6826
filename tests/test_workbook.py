"""The workbook source over files written here, with the standard library alone."""

import zipfile

import pytest

from tallyfield.sources import content, workbook

_HEAD = '<?xml version="1.0"?>'
_NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def letters(n):
    return chr(65 + n)


def write(path, rows, sheet="Sheet1", merges=()):
    cells = []
    for r, row in enumerate(rows, 1):
        inner = "".join(
            f'<c r="{letters(c)}{r}" t="e"><v>#REF!</v></c>' if v == "#REF!" else f'<c r="{letters(c)}{r}"><v>{v}</v></c>' if isinstance(v, (int, float)) else f'<c r="{letters(c)}{r}" t="inlineStr"><is><t>{v}</t></is></c>'
            for c, v in enumerate(row)
            if v is not None
        )
        cells.append(f'<row r="{r}">{inner}</row>')
    merged = "".join(f'<mergeCell ref="{m}"/>' for m in merges)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'{_HEAD}<workbook {_NS} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="{sheet}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'{_HEAD}<worksheet {_NS}><sheetData>{"".join(cells)}</sheetData><mergeCells>{merged}</mergeCells></worksheet>')


BASKET = [
    ["Report of 19 September 14:05", None, None],
    ["Farmer", "Tax ID", "Contract", "Conditioned kg", "Amount", "Odd column"],
    ["ALFA", "11", "501", 4090, "1000.0", "z"],
    ["BETA", None, "601", 33, "#REF!", None],
    ["Жами", None, None, 4123, 1000, None],
]


def test_reads_rows_and_skips_totals(spark, tmp_path):
    write(tmp_path / "basket.xlsx", BASKET, merges=["A1:L1"])
    rows = workbook.read_workbooks(spark, str(tmp_path), "basket").orderBy("source_row").collect()
    assert [(r["source_row"], r["farmer_name"], r["tax_id"], r["conditioned_kg"], r["amount"]) for r in rows] == [(3, "ALFA", "11", "4090", "1000.0"), (4, "BETA", None, "33", None)]
    assert rows[1]["bad_cells"] == ["amount"] and rows[0]["unknown_headers"] == ["Odd column"]


def test_missing_columns_are_named(tmp_path):
    write(tmp_path / "x.xlsx", [["Farmer", "Tax ID"], ["a", "1"]])
    with pytest.raises(workbook.MissingColumns, match="conditioned_kg"):
        workbook.bind(workbook.Workbook(str(tmp_path / "x.xlsx")), "Sheet1", "basket")


def test_kinds(tmp_path):
    assert [workbook.kind_of_name(x) for x in ("Basket 19.xlsx", "Историческая выписка.xlsx", "basket_shipments.xlsx", "x.xlsx")] == ["basket", "payments", None, None]
    write(tmp_path / "a.xlsx", [["anything"]], sheet="Shipments")
    assert workbook.kind_of_content(workbook.Workbook(str(tmp_path / "a.xlsx"))) == "shipments"
    write(tmp_path / "b.xlsx", [["Счет РКП", "Баланс"]])
    assert workbook.kind_of_content(workbook.Workbook(str(tmp_path / "b.xlsx"))) == "accounts"


def test_labelled_values_and_letters(tmp_path):
    write(tmp_path / "a.xlsx", [["x"], ["Client ID:", None, "77"]])
    assert workbook.Workbook(str(tmp_path / "a.xlsx")).labelled("Sheet1", "client id") == "77"
    assert [workbook.column_index(x) for x in ("A1", "Z9", "AA3")] == [0, 25, 26]


def test_unpivot_days(spark):
    wide = spark.createDataFrame([("a", 1.0, None, 3.0)], 'name string, `2026-09-18|HAND` double, `2026-09-18|MACHINE` double, `2026-09-19|HAND` double')
    got = workbook.unpivot_days(wide, ["name"], wide.columns[1:]).orderBy("day").collect()
    assert [(str(r["day"]), r["method"], r["kg"]) for r in got] == [("2026-09-18", "HAND", 1.0), ("2026-09-19", "HAND", 3.0)]


def test_content(spark, tmp_path):
    path = tmp_path / "news.json"
    path.write_text('[{"id":"1","slug":"a","date":"2026-01-01","category":"x","media_id":"m","translations":{"uz":{"title":"T"}}},{"id":"2","slug":"a","date":"2026-02-01","category":"y","translations":{}}]')
    rows = content.read_json_list(spark, str(path))
    assert [r["id"] for r in content.newest_first(rows, 1).collect()] == ["2"]
    assert {r["id"]: r["title"] for r in content.in_locale(rows, "uz").collect()} == {"1": "T", "2": None}
    assert [tuple(r) for r in content.repeated_slugs(rows).collect()] == [("a", 2)]
    assert content.by_category(rows, "x").count() == 1 and content.by_slug(rows, "a").count() == 2
    pairs = spark.createDataFrame([("k", "12"), ("bad", "x")], "key string, value string")
    assert [content.settings(pairs, k, 7.0).first()["value"] for k in ("k", "bad", "none")] == [12.0, 7.0, 7.0]


def test_names_that_begin_like_totals_stay(spark, tmp_path):
    rows = [BASKET[1], *[[name, str(i), "5", 10, "1.0", None] for i, name in enumerate(("JAMILA FX", "Жамият FX", "Total Agro MCHJ", "Итого"))], ["Итого:", None, None, 40, 4, None]]
    write(tmp_path / "basket.xlsx", rows)
    assert [r["farmer_name"] for r in workbook.read_workbooks(spark, str(tmp_path), "basket").orderBy("source_row").collect()] == ["JAMILA FX", "Жамият FX", "Total Agro MCHJ"]
    footers = workbook.read_rows(spark, str(tmp_path), "basket").where("row_kind = 'footer'").collect()
    assert [r["conditioned_kg"] for r in footers] == ["10", "40"]
    # a number in the column that numbers rows makes it a row
    numbered = [["№", *BASKET[1]], ["1", "Итого", "11", "5", 10, "1.0", None], ["Жами", None, None, None, 10, 1, None]]
    write(tmp_path / "basket.xlsx", numbered)
    assert [r["farmer_name"] for r in workbook.read_workbooks(spark, str(tmp_path), "basket").collect()] == ["Итого"]


def test_ranges_of_a_sheet_hold_every_row_once(tmp_path, monkeypatch):
    monkeypatch.setattr(workbook, "BLOCK_BYTES", 300)
    write(tmp_path / "x.xlsx", [["a", i, f"text {i}" * (i % 7)] for i in range(200)], merges=["A1:B1"])
    book = workbook.Workbook(str(tmp_path / "x.xlsx"))
    whole = list(book.rows("Sheet1"))
    assert [n for n, _, _ in whole] == list(range(1, 201))
    for step in (50, 333, 5000):
        parts = [r for low in range(0, book.size("Sheet1"), step) for r in book.rows("Sheet1", low, low + step)]
        assert parts == whole
    assert book.merges("Sheet1") == [(1, 0, 1, 1)]


LEDGER = [
    ["19 September 14:05 хўжалик ҳисоботи"],
    ["№", "Хўжалик номи", "Шартнома раками", "Шартнома миқдори", "Кабул қилиш", None, "ПК-17 имзолаш холати", None, "Физик вазни, кг", "Кондицион вазни, кг", "Бошқа"],
    [None, None, None, None, "санаси", "кайд раками", "Кластер", "Фермер", None, None, None],
    [1, "ALFA", "501", 100, "18.09.2026", "7", "10:20:30 18.09.2026", "11:00:00 18.09.2026", 1000, 950, "x"],
    [2, None, "501", 100, "18.09.2026", "8", None, None, 10, 9, None],
    [3, "BETA", "502", 50, "19.09.2026", "9", None, None, 20, 19, None],
    ["Жами:", None, None, None, None, None, None, None, 1030, 978, None],
]


def test_tasks_share_a_sheet_and_hold_every_row_once(tmp_path, monkeypatch):
    """More tasks give smaller ranges, down to the least size; whatever their number, the rows are the same."""
    write(tmp_path / "x.xlsx", [BASKET[1], *[[f"FARM {i}", "11", "501", i, "1.0", None] for i in range(300)]])
    monkeypatch.setattr(workbook, "LEAST_PART_BYTES", 2000)
    found, parts = {}, {}
    for tasks in (1, 4, 1000):
        reader = workbook._Reader({"path": str(tmp_path / "x.xlsx"), "kind": "basket", "tasks": str(tasks)})
        parts[tasks] = reader.partitions()
        found[tasks] = [n for part in parts[tasks] for batch in reader.read(part) for n in batch.column(2).to_pylist()]
    assert [len(parts[t]) for t in (1, 4)] == [1, 4] and 4 < len(parts[1000]) < 1000
    assert found[1] == found[4] == found[1000] == list(range(2, 302))


def test_ledger_binds_by_zone_leaf_and_place(spark, tmp_path):
    from tallyfield.sources import typed

    merges = ["A1:K1", "A2:A3", "B2:B3", "C2:C3", "D2:D3", "E2:F2", "G2:H2", "I2:I3", "J2:J3", "K2:K3"]
    write(tmp_path / "ledger.xlsx", LEDGER, merges=merges)
    rows = workbook.read_rows(spark, str(tmp_path / "ledger.xlsx"), "ledger")
    data = typed.ledger(rows.where("row_kind = 'data'")).orderBy("source_row").collect()
    assert [(r["source_row"], r["farmer_name"], r["contract_number"], str(r["acceptance_date"]), r["acceptance_record_no"]) for r in data] == [(4, "ALFA", "501", "2026-09-18", "7"), (6, "BETA", "502", "2026-09-19", "9")]
    assert str(data[0]["pk17_registered_at"]) == "2026-09-18 10:20:30" and str(data[0]["pk17_signed_at"]) == "2026-09-18 11:00:00"
    assert float(data[0]["contract_qty"]) == 100 and float(data[0]["conditioned_kg"]) == 950
    assert len(workbook.fields_of("ledger")) == 47
    codes = {r["code"]: r["row"] for r in typed.ledger_issues(rows).collect()}
    assert codes == {"GRAND_TOTAL_ROW_SKIPPED": 7, "MISSING_FARMER_NAME": 5, "COLUMN_NOT_MAPPED": None}
    assert typed.ledger_totals(rows).first()["conditioned_kg"] == 978
    write(tmp_path / "none.xlsx", [["no header"]])
    with pytest.raises(workbook.MissingColumns):
        workbook.bind_ledger(workbook.Workbook(str(tmp_path / "none.xlsx")), "Sheet1")


def test_statement_with_its_meta_block_and_footer(spark, tmp_path):
    from tallyfield.operators import quality
    from tallyfield.sources import typed

    head = ["Transaction id", "Attributes", "Date", "Counterparty", "Counterparty id", "Counterparty account", "Account name", "Debit", "Credit", "Details"]
    rows = [
        ["Statement"], ["Лиц. счет клиента: 20208000 от: 01.09.2026 до: 30.09.2026"], ["Клиент ИНН", "305 001"], head,
        ["1", "C:9; D:77;", "18.09.2026 10:00:00", "ALFA", "11", "2020 8000 000000011", None, 100.5, None, "с/ф № A1"],
        ["2", "C:9; D:77;", "18.09.2026 10:00:00", "OWNER", "305001", "2020 8000 000000099", None, None, 100.5, None],
        ["3", None, "31.02.2026", "BETA", "12", "x", None, 20, None, "Возврат"], ["4", None, None, "BETA", "12", "x", None, "#REF!", None, None],
        [None, None, None, None, None, None, "Итого", 999, 1, None],
    ]
    write(tmp_path / "vypiska.xlsx", rows)
    path = str(tmp_path / "vypiska.xlsx")
    meta = workbook.statement_meta(path)
    assert meta["client_inn"] == "305001" and meta["period_from"] == "01.09.2026" and meta["account"] == "20208000"
    raw = workbook.read_rows(spark, path, "payments")
    legs = typed.statement(raw.where("row_kind = 'data'"), meta["client_inn"], meta["account"])
    got = {r["tx_id"]: r for r in legs.collect()}
    assert got["1"]["debit"] == 10050 and got["1"]["deal_number"] == "77" and got["1"]["invoice_no"] == "A1" and not got["1"]["is_company_side"]
    assert got["2"]["is_company_side"] and got["2"]["credit"] == 10050 and got["3"]["is_reversal"]
    found = quality.issues(legs, typed.statement_rules(), "PAYMENTS", legs.source_row, legs.tx_id)
    assert {(r["code"], r["ref"]) for r in found.collect()} == {("INVALID_DATE", "3"), ("MISSING_DATE", "4"), ("INVALID_AMOUNT", "4")}
    mismatch = typed.statement_total_issue(legs, raw.where("row_kind = 'footer'")).collect()
    assert [(r["code"], r["message"]) for r in mismatch] == [("STATEMENT_TOTAL_MISMATCH", "99900 against 12050")]


def test_day_blocks_of_a_hand_made_report(spark, tmp_path):
    blank = [None] * 3
    rows = [
        ["Some title"], [],
        ["№", "Фермер хўжаликлар номи", "Режа", "11,09,26 й", None, None, None, None, None, "12.09.2026", None, None, None, None, None, "Жами"],
        blank, blank, blank,
        [None, "Биринчи ҳудуди", None],
        [1, "ALFA", 10.5, 1.2345, 9, 2, 9, 3.2345, 18, None, None, 4, 1, 4, 1, 7],
        [None, "Жами", None, 5, 5],
        [None, "Кластер ер", None],
        [None, "Иккинчи ҳудуди", None],
        [2, "BETA", None, 0.5, 1, None, None, None, None, 1.5, 1],
        [None, "Ҳудудлар худуди жами", None],
        [None, "Учинчи ҳудуди", None],
        [3, "GAMMA", 7, None, None, 3],
    ]
    write(tmp_path / "report.xlsx", rows, merges=["D3:I3", "J3:O3", "A1:P1"])
    got = {(r["name"], str(r["day"]), r["method"]): (r["kg"], r["section"], r["block"]) for r in workbook.read_day_report(spark, str(tmp_path / "report.xlsx"), "Ҳудуд").collect()}
    assert got == {
        ("ALFA", "2026-09-11", "HAND"): (1235, "Ҳудуд", "Биринчи ҳудуди"), ("ALFA", "2026-09-11", "MACHINE"): (2000, "Ҳудуд", "Биринчи ҳудуди"), ("ALFA", "2026-09-12", "MACHINE"): (4000, "Ҳудуд", "Биринчи ҳудуди"),
        ("BETA", "2026-09-11", "HAND"): (500, "Кластер ер", "Иккинчи ҳудуди"), ("BETA", "2026-09-12", "HAND"): (1500, "Кластер ер", "Иккинчи ҳудуди"),
        ("GAMMA", "2026-09-11", "MACHINE"): (3000, "Ҳудуд", "Учинчи ҳудуди"),
    }
    write(tmp_path / "other.xlsx", [["a", "b"]])
    with pytest.raises(workbook.MissingColumns):
        workbook.bind_days(workbook.Workbook(str(tmp_path / "other.xlsx")), "Sheet1")


def _with_shared_strings(path, names):
    """A basket whose texts are shared strings, some of them in runs, with numbers that look like theirs beside them."""
    heads = ["Farmer", "Tax ID", "Contract", "Conditioned kg"]
    texts = heads + sorted(set(names))
    strings = "".join(f"<si><r><t>{t[:2]}</t></r><r><t>{t[2:]}</t></r></si>" if i % 2 else f"<si><t>{t}</t></si>" for i, t in enumerate(texts))
    number = {t: i for i, t in enumerate(texts)}
    rows = '<row r="1">' + "".join(f'<c r="{letters(c)}1" t="s"><v>{number[h]}</v></c>' for c, h in enumerate(heads)) + "</row>"
    rows += "".join(f'<row r="{r}"><c t="s" r="A{r}"><f>A{r}</f><v> {number[n]} </v></c><c r="B{r}"><v>{r}</v></c><c r="D{r}"><v>{r * 10}</v></c></row>' for r, n in enumerate(names, 2))
    write(path, [])
    with zipfile.ZipFile(path) as z:
        kept = {n: z.read(n) for n in z.namelist() if "sheet1" not in n}
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for n, data in kept.items():
            z.writestr(n, data)
        z.writestr("xl/sharedStrings.xml", f"<sst {_NS}>{strings}</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"{_HEAD}<worksheet {_NS}><sheetData>{rows}</sheetData></worksheet>")


def test_ranges_take_the_shared_strings_they_name_along(tmp_path, monkeypatch):
    names = [f"FARM {i % 37}" for i in range(400)]
    _with_shared_strings(tmp_path / "basket.xlsx", names)
    monkeypatch.setattr(workbook, "BLOCK_BYTES", 1000)
    parts = list(workbook._cut(str(tmp_path / "basket.xlsx"), "basket"))
    assert len(parts) > 20 and all(len(p["strings"]) < 41 for p in parts[1:])
    rows = [r for p in parts for r in workbook._parsed(p, ["farmer_name", "tax_id"]).to_pylist()]
    assert [(r["source_row"], r["farmer_name"], r["tax_id"]) for r in rows] == [(r, n, str(r)) for r, n in enumerate(names, 2)]


def test_a_sheet_is_inflated_a_fixed_number_of_times(tmp_path, monkeypatch):
    """Work grows with the sheet: its bytes are read once for the layout's merges and once for the ranges, however many ranges there are."""
    write(tmp_path / "basket.xlsx", [BASKET[1], *[[f"FARM {i}", "11", "501", i, "1.0", None] for i in range(3000)]])
    read = []
    plain = zipfile.ZipExtFile.read
    monkeypatch.setattr(zipfile.ZipExtFile, "read", lambda self, n=-1: (lambda out: read.append(len(out)) or out)(plain(self, n)))
    monkeypatch.setattr(workbook, "BLOCK_BYTES", 4000)
    parts = sum(1 for _ in workbook._cut(str(tmp_path / "basket.xlsx"), "basket"))
    size = workbook.Workbook(str(tmp_path / "basket.xlsx")).size("Sheet1")
    assert parts > 50 and sum(read) < 2.3 * size + 20_000


def test_a_folder_of_workbooks_gives_the_rows_of_the_source(spark, tmp_path):
    _with_shared_strings(tmp_path / "a basket.xlsx", [f"FARM {i}" for i in range(50)])
    write(tmp_path / "b basket.xlsx", BASKET)
    got = {(r["file"], r["source_row"], r["farmer_name"], r["conditioned_kg"], r["row_kind"]) for r in workbook.read_rows(spark, str(tmp_path), "basket").collect()}
    spark.dataSource.register(workbook.WorkbookSource)
    source = spark.read.format("workbook").option("kind", "basket").option("tasks", 4).load(str(tmp_path)).collect()
    assert got == {(r["file"], r["source_row"], r["values"].get("farmer_name"), r["values"].get("conditioned_kg"), r["row_kind"]) for r in source} and len(got) == 53
