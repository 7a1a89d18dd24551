import math
import os
import random
import zlib

import pytest
import zstandard

from lodestack.llm import quality

DOCS = "doc_id long, text string, score string, y int"


def corpus(spark, n=900):
    rng = random.Random(2)
    good = ["river", "stone", "under", "walking", "light", "evening", "garden", "quiet", "seldom", "morning"]
    bad = ["BUY!!", "CHEAP!!", "NOW$$", "CLICK!!", "WIN##", "FREE!!"]
    rows, labels = [], []
    for i in range(n):
        y = int(rng.random() < 0.75)
        rows.append((i, " ".join(rng.choices(good if y else bad, k=rng.randrange(5, 400))), "", 0))
        if i % 3:
            labels.append((i, y, 0))
    return rows, labels


def test_held_out_accuracy_and_edges(spark):
    rows, labels = corpus(spark)
    truth = {i: y for i, y, _ in labels}
    odd = [(5000, None, "", 0), (5001, "", "", 0), (5002, "river " * 200_000, "", 0), (None, "stone light", "", 0), rows[0]]
    df = spark.createDataFrame(rows + odd, DOCS).repartition(3)
    lab = spark.createDataFrame([*labels, (labels[0][0], None, 0), (None, 1, 0), (99999, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(df, lab)
    got = quality.classify(df, model).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    tested = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in tested) >= 0.95 * len(tested) > 0
    assert len({r.score for r in got if r.doc_id in (5000, 5001)}) == 1
    assert quality.fit(df.repartition(5), lab) == model
    kept = quality.keep_good(df, model)
    assert kept.columns == df.columns and kept.count() == sum(r.predicted for r in got)


def test_labels_of_held_out_rows_do_not_matter(spark):
    rows, labels = corpus(spark, 300)
    df = spark.createDataFrame(rows, DOCS)
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y, t) for i, y, t in labels]
    schema = "doc_id long, quality int, toxic int"
    assert quality.fit(df, spark.createDataFrame(labels, schema)) == quality.fit(df, spark.createDataFrame(turned, schema))


def test_no_labels_and_no_documents(spark):
    df = spark.createDataFrame([(1, "a b", "", 0)], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in quality.classify(df, quality.fit(df, none)).collect()] == [0.5]
    assert quality.classify(df.limit(0), quality.fit(df.limit(0), none)).collect() == []


def plain_score(model, text):
    """The difference of the sizes under either dictionary, block by block, each time with a fresh compressor."""
    raw, sizes = (text or "").encode(), []
    for dictionary in (model.bad, model.good):
        data = zstandard.ZstdCompressionDict(dictionary)
        packer = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)
        sizes.append(sum(len(packer.compress(raw[i : i + quality.BLOCK])) for i in range(0, len(raw), quality.BLOCK)))
    return 1 / (1 + math.exp(-(model.slope * ((sizes[0] - sizes[1]) / len(raw) if raw else 0.0) + model.offset)))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the generated tables")
def test_scores_are_those_of_plain_compression_and_calibrated(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    got = {r.doc_id: r for r in quality.op8_quality(spark, sf).collect()}
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert set(got) == set(texts)
    assert all(abs(got[k].score - plain_score(model, t)) < 0.02 for k, t in texts.items())
    truth = {r.doc_id: r.quality for r in labels.collect()}
    tested = [(r.score, truth[k]) for k, r in got.items() if r.held_out and k in truth]
    brier = sum((p - y) ** 2 for p, y in tested) / len(tested)
    share = sum(y for _, y in tested) / len(tested)
    for low in (0.0, 0.5):
        part = [(p, y) for p, y in tested if low <= p < low + 0.5 or low and p == 1]
        assert abs(sum(p - y for p, y in part)) / len(part) < 0.1
    # against a score that is the share of good labels for every text; 94 texts give 0.060, README has more
    assert brier < share * (1 - share) / 2
