import corpus_pipeline
from stratagraph.llm import bpe, mixing, pii, quality

from . import brute


def test_stages_against_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, docs, sf)
        df.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
        if name != "byte_bpe":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    net = quality.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    good = {i for i, r in before.items() if net.score((r["text"] or "").encode()) >= 0.3}
    assert set(kept["quality"]) == good and 0.6 * len(before) < len(good) < len(before)
    near = brute.near([(i, before[i]["text"]) for i in good])
    assert set(kept["near_dedup"]) == {i for i, x in near.items() if x[2]}
    assert set(kept["pii"]) == set(kept["mixing"]) == set(kept["byte_bpe"]) == set(kept["near_dedup"])
    model = pii.train()
    for i, r in kept["pii"].items():
        t = before[i]["text"]
        base = pii.base_spans(t)
        assert r["text"] == pii.redacted(t, base + pii.more_spans(t, base, model)) and r["n_chars"] == len(r["text"])
        assert not brute.personal(r["text"])
    codec = bpe.codec(*bpe.public_vocabulary())
    want = {r["doc_id"]: r["__position"] for r in mixing.mix(spark.read.parquet(str(tmp_path / "pii"))).collect()}
    got = sorted(kept["byte_bpe"].values(), key=lambda r: r["position"])
    assert [r["position"] for r in got] == list(range(len(got))) and [r["doc_id"] for r in got] == sorted(want, key=want.get)
    for i, r in kept["byte_bpe"].items():
        t = kept["mixing"][i]["text"]
        assert t == kept["pii"][i]["text"] and r["decoded_sha256"] == brute.sha(t)
        assert r["ids_sha256"] == brute.sha(" ".join(map(str, codec.encode([t])[0].tolist())))


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "position"]
    assert out.count() > 50


def test_odd_rows_in_every_stage(spark, sf, tmp_path):
    """Nulls in any column, repeated rows and ids, a clashing column, and an empty table."""
    one = "a document of several words that say little but say it in order"
    data = [(None, None, None, None, None), (1, one, None, None, None), (1, one, None, None, None), (1, "quite another text under the same id, with words of its own", "en", "s", 3), (None, one + " too", "en", "s", 3), (4, "", None, "s", None), (4, "", None, "s", None), (5, "mail x@y.org " * 40, "en", None, 2)]
    docs = spark.createDataFrame([(*r, "z") for r in data], "doc_id long, text string, lang string, source string, n_chars long, __slot string")
    for name, stage in corpus_pipeline.STAGES:
        given = docs.collect()
        df = stage(spark, docs, sf)
        df.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        got = docs.collect()
        if name == "quality":
            docs = spark.createDataFrame(data, df.schema)  # whatever is rejected: the others get all rows
        elif name == "near_dedup":
            assert sorted(str(tuple(r)[:2]) for r in got) == sorted(str(r[:2]) for r in (data[0], data[1], data[3], data[5], data[6], data[7]))
        else:
            assert len(got) == len(given)
        empty = stage(spark, spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long"), sf)
        assert empty.columns == docs.columns and empty.count() == 0
    assert sorted(r["position"] for r in got) == list(range(len(got)))
