"""Entity matching between sources: a cascade of equi-joins, and names as the last resort.

Only names whose words agree are accepted by themselves, so that step is an equi-join on sorted words;
edit distance only fills in a candidate for review.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import client_code
from ..functions.text import party_key, token_key
from ..shared import written

#: How sure each way of matching is.
CONFIDENCE = {"INN": 1.0, "CONTRACT": 0.95, "ACCOUNT": 0.9, "NAME": 0.8}
#: So many names of one length stand in a block, about, where names are compared with all.
NAME_BLOCK = 1000
#: Letters in a piece of a name, the edit distances of the rounds, and the share of all names that the lists of a name's pieces may hold together.
GRAM = 3
DISTANCES = (1, 3)
MOST_LISTED = 0.25


def farmers(harvest: DataFrame, order: Column) -> DataFrame:
    """(inn, name): the first name of every tax id."""
    return harvest.where("inn is not null").groupBy("inn").agg(F.min_by("farmer_name", order).alias("name"))


def contract_bridge(harvest: DataFrame, order: Column) -> DataFrame:
    """(contract, inn): the first tax id of every contract."""
    known = harvest.where("inn is not null and contract_number is not null")
    return known.groupBy(F.col("contract_number").alias("contract")).agg(F.min_by("inn", order).alias("inn"))


def account_bridge(payments: DataFrame, known: DataFrame, order: Column) -> DataFrame:
    """(code, inn): the tax id that the first leg with a known one shows for a client code."""
    legs = payments.select(client_code(F.col("counterparty_account")).alias("code"), F.col("counterparty_inn").alias("inn"), order.alias("_order"))
    sure = legs.where("code is not null").join(known.select("inn"), "inn", "left_semi")
    return sure.groupBy("code").agg(F.min_by("inn", "_order").alias("inn"))


def owner_bridge(payments: DataFrame, order: Column) -> DataFrame:
    """(code, owner): the statement owner's client codes; the last leg wins."""
    own = F.array(F.col("statement_account"), F.when(F.col("is_company_side"), F.col("counterparty_account")))
    legs = payments.where("client_inn is not null").select("client_inn", order.alias("_order"), F.posexplode(own).alias("_pos", "account"))
    codes = legs.select(client_code(F.col("account")).alias("code"), "client_inn", "_order", "_pos").where("code is not null")
    return codes.groupBy("code").agg(F.max_by("client_inn", F.struct("_order", "_pos")).alias("owner"))


def unique_names(harvest: DataFrame) -> DataFrame:
    """(key, tokens, inn) for the names that one tax id alone bears."""
    keyed = harvest.where("inn is not null").select(party_key(F.col("farmer_name")).alias("key"), "inn").where("key <> ''")
    alone = keyed.groupBy("key").agg(F.min("inn").alias("inn"), F.max("inn").alias("_other")).where("inn = _other").drop("_other")
    return alone.withColumn("tokens", token_key(F.col("key")))


def name_match(rows: DataFrame, name: str, names: DataFrame) -> DataFrame:
    """rows with name_inn: by equal key, else by equal words in another order (the least key of those)."""
    exact = names.select(F.col("key").alias("_key"), F.col("inn").alias("_exact"))
    loose = names.groupBy(F.col("tokens").alias("_tokens")).agg(F.min_by("inn", "key").alias("_loose"))
    keyed = rows.withColumn("_key", party_key(F.col(name))).withColumn("_tokens", token_key(F.col("_key")))
    out = keyed.join(exact, "_key", "left").join(loose, "_tokens", "left")
    return out.withColumn("name_inn", F.when(F.col("_key") != "", F.coalesce("_exact", "_loose"))).drop("_key", "_tokens", "_exact", "_loose")


def name_key(name: Column) -> Column:
    """The party key of a name; null where nothing is left of it."""
    return F.nullif(party_key(name), F.lit(""))


def words_key(name: Column) -> Column:
    return token_key(name_key(name))


def match_keys(known: DataFrame, contracts: DataFrame, accounts: DataFrame | None, names: DataFrame) -> DataFrame:
    """(way, key, found): everything that a row can be matched by, in one table; a key stands once for each way."""
    keys = known.select(F.lit("INN").alias("way"), F.col("inn").alias("key"), F.col("inn").alias("found"))
    keys = keys.unionByName(contracts.select(F.lit("CONTRACT").alias("way"), F.col("contract").alias("key"), F.col("inn").alias("found")))
    if accounts is not None:
        keys = keys.unionByName(accounts.select(F.lit("ACCOUNT").alias("way"), F.col("code").alias("key"), F.col("inn").alias("found")))
    keys = keys.unionByName(names.select(F.lit("NAME").alias("way"), "key", F.col("inn").alias("found")))
    loose = names.groupBy(F.col("tokens").alias("key")).agg(F.min_by("inn", "key").alias("found"))
    return keys.unionByName(loose.select(F.lit("WORDS").alias("way"), "key", "found"))


def first_hits(rows: DataFrame, keys: DataFrame, probes: list[tuple[str, str, Callable[[Column], Column] | None]]) -> DataFrame:
    """rows with way and found: the first of the probes (way, column, form of it) that the keys know, null where none is.

    What rows carry is brought down to the different combinations first; their keys are looked up in one join, whatever the number of ways, and
    rows are joined to the result once.
    """
    columns = list(dict.fromkeys(c for _, c, _ in probes))
    asked = rows.select(*columns).distinct()
    entries = [F.struct(F.lit(i).alias("rank"), F.lit(way).alias("way"), (form(F.col(c)) if form else F.col(c)).alias("key")) for i, (way, c, form) in enumerate(probes)]
    each = asked.select(*columns, F.explode(F.array(*entries)).alias("p")).select(*columns, "p.*").where("key is not null")
    hits = each.join(keys, ["way", "key"]).groupBy(*columns).agg(F.min(F.struct("rank", "way", "found")).alias("_hit"))
    hits = hits.select(*[F.col(c).alias(f"_{c}") for c in columns], "_hit.way", "_hit.found")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns])
    return rows.join(hits, same, "left").drop(*[f"_{c}" for c in columns])


def match(rows: DataFrame, keys: DataFrame, inn: str | None, contract: str | None, account: str | None, name: str) -> DataFrame:
    """rows with match_inn, match_method and confidence: by tax id, contract, account code, then name; the first hit counts."""
    ways = [("INN", inn, None), ("CONTRACT", contract, None), ("ACCOUNT", account, client_code), ("NAME", name, name_key), ("WORDS", name, words_key)]
    out = first_hits(rows, keys, [w for w in ways if w[1]])
    method = F.coalesce(F.when(F.col("way") == "WORDS", "NAME").otherwise(F.col("way")), F.lit("NONE"))
    sure = reduce(lambda rest, way: F.when(F.col("match_method") == way, CONFIDENCE[way]).otherwise(rest), CONFIDENCE, F.lit(0.0))
    return out.withColumnRenamed("found", "match_inn").withColumn("match_method", method).drop("way").withColumn("confidence", sure)


def cascade(
    rows: DataFrame, known: DataFrame, contracts: DataFrame, accounts: DataFrame | None, names: DataFrame,
    inn: str, contract: str, account: str | None, name: str,
) -> DataFrame:
    """match() against keys that are made for these rows alone."""
    return match(rows, match_keys(known, contracts, accounts, names), inn, contract, account if accounts is not None else None, name)


def _grams(rows: DataFrame, *keep: str) -> DataFrame:
    """rows (tokens, ...) -> keep, gram, at: the letters of tokens in overlapping pieces, the ends marked."""
    marked = F.concat(F.lit("\x02" * (GRAM - 1)), F.col("tokens"), F.lit("\x03" * (GRAM - 1)))
    pieces = F.transform(F.sequence(F.lit(1), F.length("tokens") + GRAM - 1), lambda i: F.substring(F.col("_marked"), i, F.lit(GRAM)))
    return rows.withColumn("_marked", marked).select(*keep, F.posexplode(pieces).alias("at", "gram"))


def _probed(open_: DataFrame, index: DataFrame, sizes: DataFrame, names: int, distance: int) -> tuple[DataFrame, DataFrame]:
    """(pairs, asked): pairs (tokens, length, their_tokens, their_length) that hold all within the distance for the names asked.

    An edit changes GRAM pieces of a name at most, so of its GRAM * distance + 1 rarest pieces one at least stands in every name within the
    distance, moved by no more than that. Names with fewer pieces, or whose pieces are so common that the index
    saves nothing, are not asked.
    """
    need = GRAM * distance + 1
    known = _grams(open_, "tokens", "length").join(sizes, "gram", "left")
    rare = known.groupBy("tokens", "length").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram", "at"))), 1, need).alias("rare"))
    listed = F.aggregate("rare", F.lit(0).cast("long"), lambda n, g: n + g["n"])
    asked = rare.where((F.size("rare") == need) & (listed <= names * MOST_LISTED))
    probes = asked.select("tokens", "length", F.explode("rare").alias("g")).select("tokens", "length", "g.gram", "g.at")
    theirs = index.select("gram", F.col("at").alias("_at"), "their_tokens", "their_length")
    near = probes.join(theirs, "gram").where((F.abs(F.col("at") - F.col("_at")) <= distance) & (F.abs(F.col("length") - F.col("their_length")) <= distance))
    return near.select("tokens", "length", "their_tokens", "their_length").distinct(), asked.select("tokens")


def _similarity(distance: Column) -> Column:
    return F.round(1 - distance / F.greatest("length", "their_length"), 4)


def _in_blocks(open_: DataFrame, theirs: DataFrame) -> DataFrame:
    """Pairs of the names that are left with every name whose length still allows more than `best`; names of one length stand in blocks of NAME_BLOCK."""
    counts = theirs.groupBy("their_length").agg(F.ceil(F.count("*") / NAME_BLOCK).cast("int").alias("blocks"))
    lengths = counts.agg(F.collect_list(F.struct("their_length", "blocks")).alias("lengths"))  # a row for each length of a name
    blocks = theirs.join(counts, "their_length").withColumn("block", F.pmod(F.xxhash64("their_tokens"), F.col("blocks")).cast("int"))
    asked = open_.crossJoin(F.broadcast(lengths)).select("tokens", "length", "best", F.explode("lengths").alias("l"))
    reach = F.round(F.least("length", "l.their_length") / F.greatest("length", "l.their_length"), 4)
    asked = asked.where(reach >= F.coalesce("best", F.lit(0.0))).select("tokens", "length", "l.their_length", F.explode(F.sequence(F.lit(0), F.col("l.blocks") - 1)).alias("block"))
    return asked.join(blocks.select("their_length", "block", "their_tokens"), ["their_length", "block"])


def _best_names(asked: DataFrame, theirs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(tokens, similarity, their_tokens): the best for each of the names asked; and the pairs that were compared."""
    index = written(_grams(theirs.withColumnRenamed("their_tokens", "tokens"), F.col("tokens").alias("their_tokens"), "their_length"), "index")
    sizes = written(index.groupBy("gram").agg(F.count("*").alias("n")), "sizes")
    names = theirs.count()
    open_ = asked.withColumn("best", F.lit(None).cast("double"))
    done, compared = [], []
    for distance in DISTANCES:
        pairs, sure = _probed(open_, index, sizes, names, distance)
        pairs = written(pairs.withColumn("d", F.levenshtein("tokens", "their_tokens", distance)), "pairs")
        compared.append(pairs)
        done.append(pairs.where("d >= 0").select("tokens", _similarity(F.col("d")).alias("similarity"), "their_tokens"))
        found = done[-1].groupBy("tokens").agg(F.max("similarity").alias("_found"))
        # what was not found is farther than the distance, so it is no nearer than this
        beyond = F.round(F.col("length") / (F.col("length") + distance + 1), 4)
        left = open_.join(found, "tokens", "left").join(sure.withColumn("_sure", F.lit(True)), "tokens", "left")
        left = left.withColumn("best", F.greatest("best", "_found"))
        open_ = written(left.where(~F.coalesce(F.col("_sure") & (F.col("best") > beyond), F.lit(False))).select("tokens", "length", "best"), "open")
        if open_.isEmpty():
            break
    else:
        pairs = _in_blocks(open_, theirs)
        compared.append(pairs)
        done.append(pairs.select("tokens", _similarity(F.levenshtein("tokens", "their_tokens")).alias("similarity"), "their_tokens"))
    return reduce(DataFrame.unionByName, done), compared


def _named(unmatched: DataFrame, name: str, names: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The keys asked for with their tokens; the tokens asked for; their tokens with the last key that has them."""
    keys = written(unmatched.select(party_key(F.col(name)).alias("key")).where("key <> ''").distinct().withColumn("tokens", token_key(F.col("key"))), "asked")
    asked = keys.select("tokens", F.length("tokens").alias("length")).distinct()
    theirs = names.where("key <> ''").groupBy(token_key(F.col("key")).alias("their_tokens")).agg(F.max(F.struct(F.col("key").alias("candidate_key"), F.col("inn").alias("candidate_inn"))).alias("c"))
    return keys, asked, written(theirs.withColumn("their_length", F.length("their_tokens")), "names")


def candidates(unmatched: DataFrame, name: str, names: DataFrame) -> DataFrame:
    """(key, candidate_inn, candidate_key, similarity): the most similar unique name for each distinct name, for review; of equals the last in order.

    The same rows as comparing every name with all, by an index of pieces of GRAM letters: in rounds of growing distance a name looks up its
    rarest pieces, which every name within the distance must share, and compares itself with what has them. A name is done where nothing
    farther can be as similar; the few that are never done are compared, in blocks, with all names of lengths that allow more.
    """
    keys, asked, theirs = _named(unmatched, name, names)
    found, _ = _best_names(asked, theirs)
    best = found.join(theirs.select("their_tokens", "c"), "their_tokens").groupBy("tokens").agg(F.max(F.struct("similarity", "c.candidate_key", "c.candidate_inn")).alias("b"))
    return keys.join(best, "tokens").select("key", "b.candidate_inn", "b.candidate_key", "b.similarity")


def candidate_work(unmatched: DataFrame, name: str, names: DataFrame) -> DataFrame:
    """One row: pairs of names that are compared, and all there are."""
    _, asked, theirs = _named(unmatched, name, names)
    _, compared = _best_names(asked, theirs)
    done = reduce(DataFrame.unionByName, [c.select(F.lit(1).alias("n")) for c in compared]).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("compared"))
    return done.crossJoin(asked.agg(F.count("*").alias("_a"))).crossJoin(theirs.agg(F.count("*").alias("_t"))).select("compared", (F.col("_a") * F.col("_t")).alias("pairs"))


def link_directory(known: DataFrame, directory: DataFrame) -> DataFrame:
    """farmers (inn, name, ord) full-outer directory (ord, display_name, basket_name, tax_id, ...).

    By tax id, where the last entry of an id counts; then by a name that exactly one
    entry without an id bears, which the first farmer of that name takes. Columns: inn, name, entry_ord (null: not in
    the directory), link (INN, NAME, NOT_IN_BASKET, NONE).
    """
    by_id = directory.where("tax_id is not null").groupBy(F.col("tax_id").alias("inn")).agg(F.max("ord").alias("entry_ord"))
    bare = directory.where("tax_id is null")
    forms = bare.select("ord", F.explode(F.array_distinct(F.array(party_key(F.col("display_name")), party_key(F.col("basket_name"))))).alias("key"))
    alone = forms.where("key <> ''").groupBy("key").agg(F.count("*").alias("n"), F.min("ord").alias("entry")).where("n = 1").drop("n")
    linked = known.withColumn("key", party_key(F.col("name"))).join(by_id, "inn", "left")
    rest = linked.where("entry_ord is null").join(alone, "key")
    winners = rest.groupBy("entry").agg(F.min_by("inn", "ord").alias("inn"))
    linked = linked.join(winners, "inn", "left")
    link = F.when(F.col("entry_ord").isNotNull(), "INN").when(F.col("entry").isNotNull(), "NAME").otherwise("NONE")
    ours = linked.select("inn", "name", F.coalesce("entry_ord", "entry").alias("entry_ord"), link.alias("link"))
    theirs = directory.join(ours.where("entry_ord is not null").select(F.col("entry_ord").alias("ord")), "ord", "left_anti")
    left = theirs.select(F.lit(None).cast("string").alias("inn"), F.lit(None).cast("string").alias("name"), F.col("ord").alias("entry_ord"), F.lit("NOT_IN_BASKET").alias("link"))
    return ours.unionByName(left)


def match_series(left: DataFrame, right: DataFrame, name: str = "key", day: str = "day", amount: str = "kg") -> DataFrame:
    """(left_key, right_key): series (key, day, kg) of two sources that agree on every day, where each is alone in that."""
    shape = lambda rows, side: (
        rows.groupBy(F.col(name).alias(f"{side}_key"))
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(day, amount))), lambda x: F.concat_ws("=", x[day].cast("string"), x[amount].cast("string"))), ";").alias("series"))
        .groupBy("series").agg(F.min(f"{side}_key").alias(f"{side}_key"), F.count("*").alias("n")).where("n = 1").drop("n")
    )
    return shape(left, "left").join(shape(right, "right"), "series").drop("series")


def match_series_or_names(left: DataFrame, right: DataFrame, left_names: DataFrame, right_names: DataFrame, least_days: int = 3) -> DataFrame:
    """(left_key, right_key, way): by equal series; else by the days of the left one leading the right one, at least so many; else by name.

    left and right: (key, day, kg); names: (key, name). Each step takes only keys that no step before has taken, and pairs in which each is alone.
    Leading days are told by two running sums of hashes of day and weight, 128 bits, so a series of any length costs what it is long.
    """
    days = Window.partitionBy("key").orderBy("day")
    part = lambda rows: rows.select("key", "day", F.concat_ws("=", F.col("day").cast("string"), F.col("kg").cast("string")).alias("x"))
    so_far = lambda seed, name: F.sum(F.xxhash64(F.lit(seed), "x").cast("decimal(38,0)")).over(days).alias(name)
    leads = lambda rows: part(rows).select("key", F.count("*").over(days).alias("n"), so_far(1, "s1"), so_far(2, "s2"))
    rest = lambda rows, done, side: rows.join(done.select(F.col(f"{side}_key").alias("key")), "key", "left_anti")
    one_to_one = lambda pairs: (
        pairs.withColumn("_l", F.count("*").over(Window.partitionBy("left_key"))).withColumn("_r", F.count("*").over(Window.partitionBy("right_key"))).where("_l = 1 and _r = 1").select("left_key", "right_key")
    )
    exact = match_series(left, right)
    whole = leads(rest(left, exact, "left"))
    whole = whole.join(whole.groupBy("key").agg(F.max("n").alias("n")), ["key", "n"]).where(F.col("n") >= least_days).select(F.col("key").alias("left_key"), "n", "s1", "s2")
    by_lead = one_to_one(whole.join(leads(rest(right, exact, "right")).withColumnRenamed("key", "right_key"), ["n", "s1", "s2"]).select("left_key", "right_key"))
    done = exact.select("left_key", "right_key").unionByName(by_lead)
    keyed = lambda names, side: rest(names, done, side).select(F.col("key").alias(f"{side}_key"), party_key(F.col("name")).alias("_name")).where("_name <> ''")
    by_name = one_to_one(keyed(left_names, "left").join(keyed(right_names, "right"), "_name").select("left_key", "right_key"))
    ways = [(exact, "SERIES"), (by_lead, "LEADING_DAYS"), (by_name, "NAME")]
    found = [pairs.select("left_key", "right_key", F.lit(way).alias("way")) for pairs, way in ways]
    return found[0].unionByName(found[1]).unionByName(found[2])


def _prefixes(series: DataFrame, days: DataFrame) -> DataFrame:
    """(key, n, s1, s2, some): for every key and number of leading days, two hashes of what the key has on them, and whether it has anything.

    series: (key, day, method, kg); days: (day, n), all days numbered from 1. What is 0 is as good as missing, and the order within a day doesn't count.
    """
    cells = series.where("kg <> 0").join(days, "day").groupBy("key", "n").agg(*[F.sum(F.xxhash64(F.lit(seed), "day", "method", "kg").cast("decimal(38,0)")).alias(c) for seed, c in ((1, "s1"), (2, "s2"))])
    every = series.select("key").distinct().crossJoin(F.broadcast(days.select("n")))  # a row a day: few, whatever the keys number
    so_far = Window.partitionBy("key").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    full = every.join(cells, ["key", "n"], "left")
    return full.select("key", "n", *[F.coalesce(F.sum(c).over(so_far), F.lit(0)).cast("decimal(38,0)").alias(c) for c in ("s1", "s2")], (F.count("s1").over(so_far) > 0).alias("some"))


def assign_in_order(left: DataFrame, right: DataFrame, left_names: DataFrame, right_names: DataFrame, least_days: int = 3) -> DataFrame:
    """(left_key, right_key, way, days): partners dealt out to the left keys one after the other, as a loop over them would.

    left and right: (key, day, method, kg); left_names: (key, ord, name), in the order ord; right_names: (key, name). A left key takes the one right
    key, not taken before, that agrees with it on all days; else on all but the last, and so on down to least_days, as long as it has anything on
    them; else the one of its name. Where several are free, none is taken.

    No pair of keys of one group is ever made: of a group (the same leading days, or the same name) the two members that are taken last say for
    every place in the order whether one alone is left. All keys choose at once, knowing who was taken in the round before and by whom first; rounds go on
    until nothing changes, which a loop's result is the only state to do. What repeats many times takes no more rounds than what
    stands once.
    """
    days = left.select("day").union(right.select("day")).distinct()
    days = written(days.withColumn("n", F.row_number().over(Window.orderBy("day"))), "days")  # a row a day
    last = days.count()
    series = lambda rows: _prefixes(rows.select("key", "day", "method", "kg"), days).where(F.col("n") >= min(least_days, max(last, 1)))
    by_series = lambda rows: rows.select("key", "n", F.concat_ws(":", "n", "s1", "s2").alias("g"), "some")
    named = lambda rows, *more: rows.select("key", *more, F.lit(0).alias("n"), F.concat(F.lit("name:"), name_key(F.col("name"))).alias("g"), F.lit(True).alias("some")).where("g is not null")
    theirs = written(by_series(series(right)).unionByName(named(right_names)).select("g", F.col("key").alias("right_key")).distinct(), "theirs")
    places = left_names.groupBy("key").agg(F.min("ord").alias("ord"))
    mine = by_series(series(left)).where("some").where(F.col("n") >= least_days).unionByName(named(left_names)).join(places, "key")
    # the way with most days first, names last; groups without a right key are no choice
    mine = written(mine.select(F.col("key").alias("left_key"), "ord", "n", "g").distinct().join(theirs.select("g").distinct(), "g", "left_semi"), "mine")
    picks, state = None, None
    while True:
        if picks is None:
            taken = theirs.withColumn("t", F.lit(None).cast(mine.schema["ord"].dataType))
        else:
            first = picks.groupBy("right_key").agg(F.min("ord").alias("t"))
            taken = theirs.join(first, "right_key", "left")
        late = Window.partitionBy("g").orderBy(F.desc_nulls_first("t"), "right_key")
        top = taken.withColumn("k", F.row_number().over(late)).where("k <= 2")
        groups = top.groupBy("g").agg(
            F.max(F.when(F.col("k") == 1, F.col("right_key"))).alias("right_key"), F.max(F.when(F.col("k") == 1, F.col("t"))).alias("t1"),
            F.max(F.when(F.col("k") == 2, F.col("t"))).alias("t2"), F.count("*").alias("members"),
        )
        one = (F.col("t1").isNull() | (F.col("t1") >= F.col("ord"))) & ((F.col("members") == 1) | F.coalesce(F.col("t2") < F.col("ord"), F.lit(False)))
        free = mine.join(groups, "g").where(one)
        now = written(free.groupBy("left_key").agg(F.min("ord").alias("ord"), F.max_by(F.struct("right_key", "n"), "n").alias("p")).select("left_key", "ord", "p.*"), "picks")
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("left_key", "right_key", "n").cast("decimal(38,0)"))).first())
        if seen == state:
            break
        picks, state = now, seen
    way = F.when(F.col("n") == 0, "NAME").when(F.col("n") == last, "SERIES").otherwise("LEADING_DAYS")
    return now.select("left_key", "right_key", way.alias("way"), F.col("n").alias("days"))
