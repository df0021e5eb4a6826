"""The classifier: gradients, held-out accuracy, odd rows; and the whole pipeline against its operators."""

import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyfield.llm import mixing, quality, secrets, simhash
from tests.llm import plain
from tests.llm.test_mixing import targets_of
from tests.llm.test_simhash import plain_components

SF = "/root/testdata/sf0.1"
SMALL = "/root/testdata/sf0.01"


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(0)
    x, starts, label = rng.normal(size=(9, quality.FEATURES)), np.array([0, 2, 3]), np.array([1.0, 0.0, 1.0])
    model = quality.Model(np.zeros(quality.FEATURES), np.ones(quality.FEATURES))

    def loss():
        s = model.forward(x, starts)[0]
        return -np.mean(label * np.log(s) + (1 - label) * np.log(1 - s))

    for name, g in model.gradients(x, starts, label).items():
        for at in [tuple(rng.integers(0, n) for n in g.shape) for _ in range(4)]:
            kept = model.p[name][at]
            model.p[name][at] = kept + 1e-6
            up = loss()
            model.p[name][at] = kept - 1e-6
            down = loss()
            model.p[name][at] = kept
            assert abs((up - down) / 2e-6 - g[at]) < 1e-5


def test_passages_of_long_texts_are_those_of_their_pieces():
    text = ("some words of a text that goes on, and on. " * 40_000).encode()
    whole = quality.encoded(text)
    assert len(whole) == -(-len(text) // quality.PASSAGE)
    assert np.isfinite(whole).all()


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = rows[rows.quality == 1], rows[rows.quality == 0]
    assert (good.predicted == 1).mean() > 0.98 and (bad.predicted == 0).mean() > 0.93
    order = rows.score.rank()
    auc = (order[rows.quality == 1].sum() - len(good) * (len(good) + 1) / 2) / (len(good) * len(bad))
    assert auc > 0.98


def test_held_out_rows_and_reruns(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality(docs, labels).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    # labels of held-out rows, and all columns but the text, have no part in a score
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.quality(docs.withColumns({"lang": F.lit("x"), "source": F.lit("y")}).repartition(5), turned).collect()
    assert sorted((r["doc_id"], round(r["score"], 12)) for r in rows) == sorted((r["doc_id"], round(r["score"], 12)) for r in again)


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(3, 1), (3, 0), (4, 1), (5, None), (6, 7), (None, 1), (2, 0)], "doc_id long, quality int")
    rows = quality.quality(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.quality(odd, labels.limit(0)).count() == odd.count()
    assert quality.quality(odd.limit(0), labels).count() == 0
    assert quality.accepted(odd, labels).columns == odd.columns


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "simhash near-dedup", "secret scan", "mixing", "packing"]
    good = corpus_pipeline.keep_good(spark, docs, SMALL)
    accepted = {r["doc_id"] for r in quality.quality(docs, spark.read.parquet(f"{SMALL}/labels.parquet")).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in good.collect()} == accepted
    single = corpus_pipeline.drop_near_duplicates(spark, good, SMALL)
    assert {r["doc_id"] for r in single.collect()} == {r["component_id"] for r in simhash.near_duplicates(good).collect()}
    masked = corpus_pipeline.mask_secrets(spark, single, SMALL)
    assert masked.columns == docs.columns and masked.count() == single.count()
    left = secrets.secrets(masked).agg(F.sum(F.col("n_assign") + F.col("n_access") + F.col("n_hex"))).first()[0]
    assert left == 0
    mixed = corpus_pipeline.mix_sources(spark, masked, SMALL)
    assert mixed.columns == docs.columns
    packed = corpus_pipeline.pack(spark, mixed, SMALL)
    assert packed.where("start = 0").count() == mixed.count()


def test_scores_against_a_plain_scorer(spark, odd):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    model = quality.learned(docs, labels)
    for df in (docs, odd):
        texts = sorted((str(r["doc_id"]), r["text"] or "") for r in df.collect())
        got = sorted((str(r["doc_id"]), r["score"]) for r in quality.scored(df, model).collect())
        wanted = sorted((doc, plain.score(model, text)) for doc, text in texts)
        assert [d for d, _ in got] == [d for d, _ in wanted]
        assert np.allclose([x for _, x in got], [x for _, x in wanted], atol=2e-3)


def test_pipeline_against_plain_stages(spark):
    """run() over whole tables: what every stage keeps, masks, takes and encodes is what plain Python makes of it."""
    folder = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = quality.learned(docs, labels)
    good = [d for d, r in rows.items() if plain.score(model, r["text"]) >= quality.THRESHOLD]
    classes = {int(d): int(c) for d, _, c in plain_components([(d, rows[d]["text"]) for d in good])}
    single = [d for d in good if classes[d] == d]
    texts = plain.masked([(d, rows[d]["text"], rows[d]["lang"], rows[d]["source"]) for d in single])

    encoder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    encode = lambda text: [*encoder.encode(text, add_special_tokens=False).ids, 2]
    whole = {d: encode(t) for d, t in texts.items()}
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert sorted(r["sequence_id"] for r in pieces) == list(range(len(pieces)))
    taken = {}
    for r in pieces:
        assert r["doc_id"] in whole and r["offset"] == 0 and r["length"] & (r["length"] - 1) == 0
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(ids) == r["length"]
        if r["doc_tokens"] == len(whole[r["doc_id"]]):
            assert ids == whole[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        taken.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], ids))
    words = {d: len((t or "").encode().split()) for d, t in texts.items()}
    by_source = {}
    for (doc, tokens), parts in taken.items():
        times = sum(start == 0 for start, _ in parts)
        n = words[doc]
        if tokens != len(whole[doc]):  # a pass that takes the first words of the text
            ids = [x for _, part in sorted(parts) for x in part]
            cut = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", texts[doc])
            n = next(k for k in range(1, n + 1) if encode("".join(cut[:k])) == ids)
            assert times == 1
        by_source[rows[doc]["source"]] = by_source.get(rows[doc]["source"], 0) + n * times
        assert times <= 3
    sources = sorted({rows[d]["source"] for d in single}, key=lambda s: (s is None, (s or "").encode()))
    wanted = targets_of([sum(words[d] for d in single if rows[d]["source"] == s) for s in sources], [mixing.WEIGHTS[i % 3] for i in range(len(sources))])
    assert all(abs(by_source.get(s, 0) - t) <= 1 for s, t in zip(sources, wanted, strict=True))


def test_pipeline_of_odd_rows(spark, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1), (4, 0), (None, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, str(tmp_path))
        assert out.columns == odd.columns, name
        assert stage(spark, odd.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).columns[:2] == ["doc_id", "start"]


def test_all_passages_are_learned_from(spark, docs):
    text = "word " * 30_000
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, quality int")
    bags, _ = quality._sample(docs(*[(i, text) for i in range(8)]), labels, "quality", 100)
    assert bags and all((bag == quality.encoded(text.encode())).all() for bag in bags) and len(bags[0]) > 260


def test_sample_is_bounded_by_bytes(spark, docs, monkeypatch):
    """Documents are learned from in the order of their hashes while their bags fit; each with all its passages."""
    table = docs(*[(i, "word " * (40 * (i % 9 + 1))) for i in range(60)])
    labels = table.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    every, _ = quality._sample(table, labels, "quality", 100)
    size = sum(b.nbytes for b in every)
    monkeypatch.setattr(quality, "SAMPLE_BYTES", size // 3)
    some, y = quality._sample(table, labels, "quality", 100)
    assert 0 < len(some) == len(y) < len(every) and size // 6 < sum(b.nbytes for b in some) <= size // 3
    whole = {b.tobytes() for b in every}
    assert all(b.tobytes() in whole for b in some)
    monkeypatch.setattr(quality, "SAMPLE_BYTES", size)
    again, _ = quality._sample(table, labels, "quality", 100)
    assert len(again) == len(every) and all((a == b).all() for a, b in zip(again, every, strict=True))
