"""Scalar functions and small sources over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, keys, numbers, text
from ..operators.relational import counts_by
from ..sources import content, workbook
from ..sources.tables import table
from .registry import query

_TRANSLATE = "".join(k for k, v in text.LATIN.items() if len(v) == 1), "".join(v for v in text.LATIN.values() if len(v) == 1).replace("'", "''")
_CLEAN_RAW = r"trim(regexp_replace(raw, '[\s]+', ' ', 'g'))"


def _latin_sql(expression: str) -> str:
    out = f"translate(lower({expression}), '{_TRANSLATE[0]}', '{_TRANSLATE[1]}')"
    for letter, form in text.LATIN.items():
        if len(form) != 1:
            out = f"replace({out}, '{letter}', '{form.replace(chr(39), chr(39) * 2)}')"
    return out


#: Text put together from the tables' columns, so that every branch of a function occurs.
_NAMES = """names AS (SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN '"' || s_name || '" ФХ' WHEN 1 THEN 'МЧЖ  Полвон қўшар ' || s_suppkey WHEN 2 THEN 'POLVON QO_SHAR-' || s_suppkey || ' FX' ELSE '  ' || s_name || ', MCHJ' END AS raw FROM supplier)"""


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    raw = (
        F.when(key % 4 == 0, F.concat(F.lit('"'), "s_name", F.lit('" ФХ'))).when(key % 4 == 1, F.concat(F.lit("МЧЖ  Полвон қўшар "), key.cast("string")))
        .when(key % 4 == 2, F.concat(F.lit("POLVON QO_SHAR-"), key.cast("string"), F.lit(" FX"))).otherwise(F.concat(F.lit("  "), "s_name", F.lit(", MCHJ")))
    )
    return table(spark, sf_dir, "supplier").select(key.alias("id"), raw.alias("raw"))


@query(rf"""WITH {_NAMES} SELECT id, trim(regexp_replace(raw, '[\s]+', ' ', 'g')) AS clean,
    trim(regexp_replace(regexp_replace(lower(trim(regexp_replace(raw, '[\s]+', ' ', 'g'))), '[.,:;()"«»№#]', ' ', 'g'), '\s+', ' ', 'g')) AS header FROM names""")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("id", text.clean(F.col("raw")).alias("clean"), text.header_key(F.col("raw")).alias("header"))


@query(f"WITH {_NAMES} SELECT id, {_latin_sql('raw')} AS latin FROM names")
def transliterate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("id", text.latin(F.col("raw")).alias("latin"))


@query(rf"""WITH {_NAMES}, w AS (SELECT id, list_filter(list_transform(string_split(trim(regexp_replace(regexp_replace(replace({_latin_sql(_CLEAN_RAW)}, '_', ''''), '[-–—/\\.,;:()"«»№]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda t: replace(t, '''', '')),
    lambda t: t NOT IN ('', {", ".join(f"'{x}'" for x in text.LEGAL_FORMS)})) AS words FROM names) SELECT id, array_to_string(words, ' ') AS key, array_to_string(list_sort(words), ' ') AS tokens FROM w""")
def party_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = text.party_key(F.col("raw"))
    return _names(spark, sf_dir).select("id", key.alias("key")).withColumn("tokens", text.token_key(F.col("key")))


@query("""SELECT p_partkey AS id, levenshtein(p_name, p_type) AS distance FROM part""")
def edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.levenshtein("p_name", "p_type").cast("long").alias("distance"))


@query("""WITH s AS (SELECT o_orderkey AS id, ['Approved', 'одобрено ', 'PENDING', 'в ожидании', 'Отклонён', 'cancelled', 'Отменено.', 'other', ''][o_orderkey % 9 + 1] AS raw FROM orders)
    SELECT id, CASE WHEN k IN ('approved', 'одобрено', 'одобрен', 'утверждено', 'active') THEN 'ACTIVE' WHEN k IN ('pending', 'в ожидании', 'на рассмотрении') THEN 'PENDING' WHEN k IN ('rejected', 'отклонено', 'отклонен') THEN 'REJECTED'
    WHEN k IN ('cancelled', 'canceled', 'отменено', 'отменен') THEN 'CANCELLED' ELSE 'UNKNOWN' END AS status FROM (SELECT id, trim(replace(replace(lower(raw), 'ё', 'е'), '.', ' ')) AS k FROM s)""")
def status_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.array(*map(F.lit, ("Approved", "одобрено ", "PENDING", "в ожидании", "Отклонён", "cancelled", "Отменено.", "other", "")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.shipment_status(raw[(F.col("o_orderkey") % 9).cast("int")]).alias("status"))


@query("""SELECT o_orderkey AS id, ['HAND', 'HAND', 'MACHINE', 'MACHINE', 'UNKNOWN', 'HAND'][o_orderkey % 6 + 1] AS method FROM orders""")
def method_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.array(*map(F.lit, ("1-Qo`l terimi", "Қўл терими", "Mashina terimi", "Машина терими", "бошқа", "ручной сбор")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.harvest_method(raw[(F.col("o_orderkey") % 6).cast("int")]).alias("method"))


@query("""WITH t AS (SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'C: ' || user_id || '; D: ' || event_id || ';' WHEN 1 THEN 'C:' || user_id || ';' ELSE '' END AS a, CASE WHEN event_id % 2 = 0 THEN 'оплата сд. № ' || user_id || ', с/ф № A-' || event_id || ', Возврат' END AS x,
    '2020 ' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS acc FROM events)
    SELECT id, coalesce(nullif(regexp_extract(a, 'D:\\s*(\\d+)', 1), ''), nullif(regexp_extract(coalesce(x, ''), 'сд\\.?\\s*№\\s*(\\d+)', 1), '')) AS deal, nullif(regexp_extract(a, 'C:\\s*(\\d+)', 1), '') AS clearing,
    nullif(regexp_extract(coalesce(x, ''), 'с/ф\\.?\\s*№\\s*([^\\s,]+)', 1), '') AS invoice, x IS NOT NULL AS reversal, right(regexp_replace(acc, '\\D', '', 'g'), 9) AS code FROM t""".replace("\\\\", "\\"))
def attr_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, user = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    way = F.col("event_id") % 3
    attributes = F.when(way == 0, F.concat(F.lit("C: "), user, F.lit("; D: "), key, F.lit(";"))).when(way == 1, F.concat(F.lit("C:"), user, F.lit(";"))).otherwise("")
    details = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("оплата сд. № "), user, F.lit(", с/ф № A-"), key, F.lit(", Возврат")))
    account = F.concat(F.lit("2020 "), F.lpad(key, 12, "0"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), keys.deal_number(attributes, details).alias("deal"), keys.clearing_contract(attributes).alias("clearing"),
        keys.invoice_number(F.lit(None).cast("string"), details).alias("invoice"), keys.is_reversal(details).alias("reversal"), keys.client_code(account).alias("code"),
    )


@query("""WITH t AS (SELECT event_id AS id, CAST(CAST(value AS DECIMAL(18,2)) * 100 AS BIGINT) AS minor, event_id % 4 AS way FROM events)
    SELECT id, CAST(minor AS DOUBLE) AS minor, CAST(round(CAST(minor AS DECIMAL(20,0)) * 0.2, 0) AS DOUBLE) AS share FROM t""")
def money_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    value, way = F.col("value").cast("decimal(18,2)"), F.col("event_id") % 4
    plain = value.cast("string")
    comma = F.translate(plain, ".", ",")
    written = F.when(way == 0, plain).when(way == 1, comma).when(way == 2, F.concat(F.lit(" "), plain, F.lit("4 so'm"))).otherwise(F.concat(F.lit("0."), F.lit("000,"), F.lpad(plain, 9, "0")))
    # the last form has groups before its decimal mark: 0.000,000012.34 is rebuilt from whole and part below
    last = F.concat(F.lit("0,000"), F.lpad(F.split(plain, r"\.")[0], 3, "0"), F.lit("."), F.split(plain, r"\.")[1])
    minor = numbers.minor_units(F.when(way == 3, last).otherwise(written))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), minor.cast("double").alias("minor"), numbers.percent_of(minor, 20).cast("double").alias("share"))


@query("""SELECT event_id AS id, CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) AS loose, CASE WHEN event_id % 3 = 2 THEN NULL ELSE CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) END AS strict FROM events""")
def number_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain, way = F.col("value").cast("decimal(18,2)").cast("string"), F.col("event_id") % 3
    written = F.when(way == 0, F.concat(F.lit(" "), plain)).when(way == 1, F.translate(plain, ".", ",")).otherwise(F.concat(plain, F.lit("-x")))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), numbers.loose_number(written).alias("loose"), numbers.number(written).alias("strict"))


@query("""SELECT l_orderkey AS id, l_linenumber AS n, CASE WHEN l_orderkey % 10 <> 9 THEN CAST(l_shipdate AS DATE) END AS day, l_orderkey % 10 = 9 AS impossible, count(*) AS rows FROM lineitem GROUP BY 1, 2, 3, 4""")
def date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, way = F.col("l_shipdate").cast("date"), F.col("l_orderkey") % 10
    serial = F.datediff(day, F.lit("1899-12-30").cast("date")).cast("string")
    written = (
        F.when(way == 0, F.date_format(day, "dd.MM.yyyy")).when(way == 4, F.date_format(day, "dd-MM-yyyy")).when(way == 5, F.concat(F.date_format(day, "d/M/yyyy"), F.lit(", 14:05")))
        .when(way == 6, F.concat(F.date_format(day, "dd.MM.yyyy"), F.lit("T14:05"))).when(way == 7, F.concat(F.lit("14:05:00 "), F.date_format(day, "dd-MM-yyyy")))
        .when(way == 8, F.when(F.year(day) < 2000, F.date_format(day, "yyyy-MM-dd'T'00:00:00")).otherwise(F.date_format(day, "dd.MM.yy"))).when(way == 1, F.date_format(day, "yyyy-MM-dd")).when(way == 2, F.concat(F.lit("10:20:30 "), F.date_format(day, "d.M.yyyy")))
        .when(way == 3, serial).otherwise(
            # no dates: a day that no month has, an ISO form with one digit, and serial numbers before 1990 and after 2100
            F.when(F.col("l_linenumber") % 4 == 0, F.concat(F.lit("31.02."), F.date_format(day, "yyyy"))).when(F.col("l_linenumber") % 4 == 1, F.concat(F.date_format(day, "yyyy-MM-"), F.lit("5")))
            .when(F.col("l_linenumber") % 4 == 2, F.datediff(F.add_months(day, -480), F.lit("1899-12-30").cast("date")).cast("string")).otherwise(F.datediff(F.add_months(day, 1320), F.lit("1899-12-30").cast("date")).cast("string"))
        )
    )
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), dates.date(written).alias("day"), dates.is_impossible(written).alias("impossible"))
    return rows.groupBy("id", "n", "day", "impossible").agg(F.count("*").alias("rows"))


@query("""SELECT DISTINCT strftime(CAST(o_orderdate AS DATE), '%d.%m.%Y') AS shown, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS loose FROM orders""")
def date_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = dates.shown_date(F.col("o_orderdate").cast("date"))
    return table(spark, sf_dir, "orders").select(shown.alias("shown"), dates.loose_date_text(shown).alias("loose")).distinct()


@query("""SELECT l_returnflag AS flag, unnest(['quantity', 'price', 'discount']) AS stage, unnest([round(CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE), 4), round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE), 4), round(CAST(sum(CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE), 4)]) AS total FROM lineitem GROUP BY 1""")
def unpivot_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    add = lambda c, kind, name: F.round(F.sum(F.col(c).cast(kind)).cast("double"), 4).alias(name)
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(
        add("l_quantity", "decimal(12,2)", "quantity"), add("l_extendedprice", "decimal(18,2)", "price"), add("l_discount", "decimal(4,2)", "discount")
    )
    return sums.unpivot("flag", ["quantity", "price", "discount"], "stage", "total")


@query("""SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1""")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts_by(table(spark, sf_dir, "events").select(F.from_json("props", "k bigint")["k"].alias("k")), "k")


@query("""SELECT doc_id AS id, source AS category, n_chars AS n FROM documents WHERE lang = 'de'""")
def locale_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("category"), F.create_map("lang", F.struct(F.col("n_chars").alias("n"))).alias("translations"))
    return content.in_locale(entries.where("translations['de'] is not null"), "de")


@query("""SELECT source AS slug, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1""")
def repeated_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.repeated_slugs(table(spark, sf_dir, "documents").select(F.col("source").alias("slug")))


@query("""SELECT doc_id AS id, n_chars AS date FROM documents ORDER BY n_chars DESC, doc_id LIMIT 3""")
def newest_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.newest_first(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("date")), 3)


@query("""SELECT page_id, locale FROM pages CROSS JOIN (VALUES ('uz'), ('ru'), ('en')) AS l(locale)""")
def path_locale_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.site_paths(table(spark, sf_dir, "pages").select("page_id"), ["uz", "ru", "en"])


@query("""SELECT e.event_id, c.c_name AS url FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id""")
def media_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("url"))
    entries = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("media_id"))
    return content.with_media(entries, media).select("event_id", "url")


@query("""SELECT page_id AS id, ['basket', 'payments', 'accounts', 'shipments', NULL, NULL][page_id % 6 + 1] AS kind FROM pages""")
def classify_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ("Саватда 1.xlsx", "Историческая выписка.xlsx", "Лицевые счета.xlsx", "Shipments.xlsx", "basket and shipments.xlsx", "other.xlsx")))
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), names[(F.col("page_id") % 6).cast("int")].alias("file_name"))
    return workbook.classify_names(rows).select("id", "kind")


@query("""SELECT c_custkey AS id, c_acctbal > 0 AS positive, greatest(0, least(100, c_acctbal / 50)) AS progress FROM customer""")
def progress_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    balance = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (balance > 0).alias("positive"), numbers.clamp_pct(balance / 50).alias("progress"))


@query("""SELECT page_id AS id, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped, regexp_replace(lower(url), '[^a-z0-9._-]+', '-', 'g') AS file_name FROM pages""")
def escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), text.html_escaped(F.col("url")).alias("escaped"), text.file_name_safe(F.col("url")).alias("file_name"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'pk17:' || o_orderkey ELSE 'fp:' || substr(sha1(o_custkey || '|' || o_orderstatus), 1, 16) END AS identity FROM orders""")
def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey").cast("string"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), keys.operation_identity(signed, F.col("o_custkey"), F.col("o_orderstatus")).alias("identity"))
