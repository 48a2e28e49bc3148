import base64
import math
import random
import re
import textwrap
import time
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from stratagraph.functions import session
from stratagraph.llm import ann, bpe, chat, common, gif, license, minhash, mixing, pii, quality, queries, suffix

from . import brute

DDL = "doc_id long, text string, lang string, source string, n_chars long, key string, id long, n long, rep long, root string"


def base_texts():
    r = random.Random(5)
    word = lambda: "".join(r.choice(("an", "the", "re", "ti", "on", "sch", "é", "que", "os", "in")) for _ in range(r.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, one = prose(60), prose(200)
    near = [" ".join(w if r.random() > 0.015 else word() for w in one.split()) for _ in range(30)]
    odd = [
        None, "", " ", "a", "Two words", "two WORDS", "x" * 99, "x" * 100, "x" * 101, "x" * 3000, "ab" * 2000, "\n\t \x0b", prose(30_000),
        passage + prose(40), prose(20) + passage, prose(9) + " " + passage + prose(3) + passage, one, one, one.upper(), "é" * 150, "\x00" * 130 + "ü" * 64,
        "mail a@b.co, x_y@z.org_q@r.st 1.2.3.4.5.6.7.8 999.1.1.1 4465758382889437 4465 7583 8288 9437 +1 (523) 555-1055 +12",
        "Licensed under the Apache License, Version 2.0.\nCC BY mit license MIT-License gnu general public license",
        "password=e3b0c44298fc1c14 and 'll it's  we've 　 naïve\x1c 中文字 12345 ½ 😀",
    ]
    return odd + near + [prose(r.randint(1, 300)) for _ in range(40)]


@pytest.fixture(scope="module")
def rows():
    return [(i * 3, t) for i, t in enumerate(base_texts())]


@pytest.fixture(scope="module")
def docs(spark, rows):
    data = [(i, t, None, None if i % 7 == 0 else f"s{i % 4}", None, "x", 1, 2, 3, "y") for i, t in rows]
    return spark.createDataFrame(data, DDL).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


def held(df, *names):
    out = {}
    for r in df.collect():
        assert r["doc_id"] not in out
        out[r["doc_id"]] = tuple(r[n] for n in names)
    return out


def test_repeats_are_cut(docs, rows, empty, monkeypatch):
    want = brute.repeats(rows)
    names = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert held(suffix.dedup(docs), *names) == want
    assert any(0 < x[1] < x[0] for x in want.values())
    kept = suffix.dedup(docs, keep=True).collect()
    assert all(brute.sha(bytes(r["kept"])) == r["kept_sha256"] and sum(s["end"] - s["start"] for s in r["removed"]) == r["n_removed"] for r in kept)
    assert suffix.dedup(empty).count() == 0


def test_long_texts_are_cut_in_pieces():
    r = random.Random(2)
    data = bytes(r.choices(b"abc", k=5000)) + b"q" * 700
    data += data[1000:3000]
    whole = suffix._stretches(np.frombuffer(data, np.uint8), np.array([0]), np.array([len(data)]))
    assert whole[1].sum() == len(data) - 99
    start, n = whole[0], whole[1]
    texts = [data[s : s + k - 1 + 100] for s, k in zip(start, n, strict=True)]
    which, where = suffix.repeated_windows(texts, np.zeros(len(n), np.int64), start)
    first: dict = {}
    again = [i for i in range(len(data) - 99) if first.setdefault(data[i : i + 100], i) != i]
    assert sorted(where.tolist()) == again


@pytest.mark.parametrize("data", [b"", b"a", b"aaaaaa", b"abracadabra abracadabra", bytes(random.Random(1).choices(b"ab", k=120))])
def test_longest_previous_factors(data):
    want = [max((max(k for k in range(len(data) - i + 1) if data[i : i + k] == data[j : j + k]) for j in range(i)), default=0) for i in range(len(data))]
    assert suffix.longest_previous_factors(data).tolist() == want


def test_repeated_rows_and_null_ids(spark):
    t = "word " * 60
    df = spark.createDataFrame([(4, t), (4, t), (None, t), (9, t)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_removed"]) for r in suffix.dedup(df).collect()), key=str)
    one = brute.repeats([(4, t)])[4][1]
    assert got == sorted([(4, one), (4, one), (None, 300), (9, 300)], key=str)
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(4, 4, True), (4, 4, True), (None, 4, False), (9, 4, False)], key=str)


def test_near_duplicates(docs, rows, empty):
    want = brute.near(rows)
    assert held(minhash.near_duplicates(docs), "n_shingles", "component_id", "kept") == want
    assert len({x[1] for x in want.values()}) < len(want) - 20
    assert {r["doc_id"] for r in minhash.keep_first(docs).select("doc_id").collect()} == {d for d, x in want.items() if x[2]}
    assert minhash.near_duplicates(empty).count() == 0


def test_links_at_the_border_and_in_blocks(spark, monkeypatch):
    """Chains of links whose ends are not alike, with pairs just at and just under 0.75."""
    words = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join(words[k * 8 : k * 8 + 60])) for k in range(40)]
    rows += [(100 + k, " ".join(words[:46] + [f"z{k}_{i}" for i in range(k)])) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.near(rows)
    assert held(minhash.near_duplicates(df), "n_shingles", "component_id", "kept") == want
    monkeypatch.setattr(minhash, "GROUP_SHINGLES", 100)
    assert held(minhash.near_duplicates(df), "n_shingles", "component_id", "kept") == want


def test_heavy_first_bands_lose_no_link(docs, rows, monkeypatch):
    monkeypatch.setattr(minhash, "MOST_PAIRED", 3)
    monkeypatch.setattr(minhash, "SALTS", 4)
    assert held(minhash.near_duplicates(docs), "n_shingles", "component_id", "kept") == brute.near(rows)


def test_links_are_confirmed_on_words(spark):
    """Two words of equal polynomial hash modulo 2**64, whatever its base, are still two words."""
    one = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{one} w x y z"), (2, f"{other} w x y z"), (3, f"{one}  W x\ty z "), (4, "a a a a a"), (5, "a a a a a a"), (6, "a a a a")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = held(minhash.near_duplicates(df), "n_shingles", "component_id", "kept")
    assert got == brute.near(rows) and got[2] == (1, 2, True) and got[3] == (1, 1, False) and got[5][1] == 4
    assert sorted(r["doc_id"] for r in minhash.keep_first(df).collect()) == [1, 2, 4, 6]


def test_one_row_of_a_class_stays(spark):
    a, b = "one two three four five six seven eight", "another text that is like nothing else in here"
    long = " ".join(f"w{k}" for k in range(60))
    data = [(1, a, "x"), (5, a, "x"), (5, b, "x"), (7, b, "x"), (5, b, "x"), (None, long, "x"), (None, long + " end", "x"), (None, " ", "x"), (9, "", "x"), (9, "", "x"), (9, None, "x")]
    df = spark.createDataFrame(data, "doc_id long, text string, cls string")
    got = [tuple(r) for r in minhash.keep_first(df).collect()]
    assert sorted(x[:2] for x in got if x[0] in (1, 5, 7)) == [(1, a), (5, b)]
    assert sum(x[0] == 9 for x in got) == 3 and sum(x[0] is None for x in got) == 2
    links = minhash.near_duplicates(df.unionByName(spark.createDataFrame([(3, long + " end of it", "y")], df.schema))).collect()
    assert sorted(r["component_id"] for r in links if r["doc_id"] is None and r["n_shingles"]) == [3, 3]
    assert minhash.keep_first(df.limit(0)).count() == 0


def test_codes_tell_runs_apart():
    r = np.random.default_rng(1)
    for vocabulary in (3, 9000, 1 << 40):
        ids = r.integers(0, min(vocabulary, 4), 400) * (vocabulary // 4 or 1) % vocabulary
        got = minhash.codes(ids, 5, vocabulary)
        runs = [tuple(ids[i : i + 5]) for i in range(396)]
        assert len(set(zip(got.tolist(), runs, strict=True))) == len(set(runs)) == len(set(got.tolist()))


def test_components_of_hubs_and_chains(spark, monkeypatch):
    from stratagraph.llm import components

    monkeypatch.setattr(components, "PARTS", 3)
    edges = [(0, k) for k in range(1, 30)] + [(k, k + 1) for k in range(100, 130)] + [(200, 200), (29, 28), (28, 29)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r["node"]: r["root"] for r in components.components(df).collect()}
    assert got == {**dict.fromkeys(range(30), 0), **dict.fromkeys(range(100, 131), 100)}
    assert components.components(df.limit(0)).count() == 0


def lag(order, weights):
    total, seen = sum(weights.values()), dict.fromkeys(weights, 0)
    worst = 0
    for t, s in enumerate(order, 1):
        seen[s] += 1
        worst = max(worst, *(abs(seen[x] - t * weights[x] / total) for x in weights))
    return worst


@pytest.mark.parametrize("weights", [{"a": 0.70049, "b": 0.29951}, {"a": 1.0, "b": 1e-6, "c": 0.3}, {"a": 5, "b": 3, "c": 0.1, None: 2}])
def test_schedule_keeps_within_a_block(weights):
    """Of the exact weights, over a hundred thousand slots."""
    names, order = mixing.plan({s: max(1, round(10**5 * w / sum(weights.values()))) for s, w in weights.items()}, weights)
    order = [names[k] for k in order]
    last = {s: t for t, s in enumerate(order)}
    assert len(order) >= 10**5 - 5
    assert lag(order[: min(last.values()) + 1], weights) < 1


def planned(counts, weights, block):
    """(source, block) of every slot, by earliest deadlines over all waiting blocks at every slot."""
    left = {s: -(-n // block) for s, n in counts.items()}
    done, out = dict.fromkeys(left, 0), []
    while left:
        total = sum(Fraction(weights[s]) for s in left)
        share = {s: Fraction(weights[s]) / total for s in left}
        at, t = dict.fromkeys(left, 0), 0
        while all(at[s] < left[s] for s in left):
            may = [s for s in left if at[s] // share[s] <= t]
            s = min(may, key=lambda s: (math.ceil((at[s] + 1) / share[s]), at[s], str(s)))
            out.append((s, done[s]))
            at[s], done[s], t = at[s] + 1, done[s] + 1, t + 1
        left = {s: n - at[s] for s, n in left.items() if n > at[s]}
    return out


def test_mixing_against_a_plain_schedule(spark):
    """All rows, with null and repeated ids and repeated rows, a clashing column and weights that don't divide anything."""
    data = [(None if k % 3 == 0 else k % 50, "abc"[k % 3 if k % 7 else 0] if k % 11 else None, f"t{k % 200}", "x") for k in range(3000)]
    df = spark.createDataFrame(data, "doc_id long, source string, text string, n string").repartition(7)
    weights = {"a": 0.70049, "b": 0.2, "c": 1e-6, None: 0.11}
    counts = Counter(s for _, s, _, _ in data)
    got = mixing.mix(df, weights, block=7).collect()
    assert Counter((r["doc_id"], r["source"], r["text"], r["n"]) for r in got) == Counter(data)
    want = planned(counts, weights, 7)
    assert {r["__slot"]: (r["source"], r["__block"]) for r in got} == dict(enumerate(want))
    assert len({r["__position"] for r in got}) == len(data)
    again = mixing.mix(df.coalesce(1), weights, block=7).collect()
    assert sorted((r["__position"], str(r["doc_id"]), r["text"]) for r in got) == sorted((r["__position"], str(r["doc_id"]), r["text"]) for r in again)
    spread = mixing._hashed(df.where("doc_id is null"), "source", "doc_id", 17)
    assert spread.select("__hash").distinct().count() > 150
    with pytest.raises(ValueError):
        mixing.mix(df.withColumn("__slot", df["n"]))


def test_mixed_order_is_read_back(spark, tmp_path):
    df = spark.range(20_000).selectExpr("id as doc_id", "if(id % 3 < 2, 'hot', concat('s', id % 5)) as source", "repeat('x', cast(id % 900 as int)) as text")
    want = {r["doc_id"]: r["__position"] for r in mixing.mix(df).collect()}
    mixing.mixed(df).write.parquet(str(tmp_path / "mixed"))
    read = spark.read.parquet(str(tmp_path / "mixed"))
    got = [r["doc_id"] for r in mixing.places(read).orderBy("position").collect()]
    assert got == sorted(want, key=want.get)
    assert mixing.places(read).agg({"position": "max"}).first()[0] == 19_999
    assert mixing.places(read.where("doc_id < 0")).count() == 0


def test_mixing_keeps_all_rows_in_proportion(docs, rows, empty, spark):
    got = mixing.mix(docs, block=2).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, _ in rows)
    assert len({r["__position"] for r in got}) == len(got)
    slots: dict = {}
    for r in got:
        assert slots.setdefault(r["__slot"], (r["source"], r["__block"])) == (r["source"], r["__block"])
    assert sorted(slots) == list(range(len(slots)))
    big = spark.range(30_000).selectExpr("id as doc_id", "if(id % 3 < 2, 'hot', concat('s', id % 5)) as source")
    weights = {"hot": 1.0, **{f"s{k}": 2.0 for k in range(5)}}
    seen: dict = {}
    for r in mixing.mix(big, weights, block=10).collect():
        seen[r["__slot"]] = r["source"]
    order = [seen[k] for k in sorted(seen)]
    assert lag(order[: 5 * order.index("hot", 500)][:1000], weights) < 1
    assert mixing.mix(empty).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(big, {"hot": 1.0})
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == len(rows)


def test_long_mixes_follow_the_exact_weights(spark):
    """Over many thousand slots no source is a block off, also one of far under a thousandth."""
    n = {"hot": 12_000, "rare": 12, **{f"s{k}": 900 + 37 * k for k in range(19)}}
    rows = spark.createDataFrame([(s, k) for s, k in n.items()], "source string, n long")
    rows = rows.selectExpr("source", "explode(sequence(1L, n)) as i").selectExpr("xxhash64(source, i) as doc_id", "source")
    for weights in (mixing.tempered(n), {s: k + (s == "rare") * 0.3 for s, k in n.items()}):
        seen = {r["__slot"]: r["source"] for r in mixing.mix(rows, weights, block=1).collect()}
        order = [seen[t] for t in range(sum(n.values()))]
        last: dict = {s: t for t, s in enumerate(order)}
        assert lag(order[: min(last.values()) + 1], weights) < 1


def test_chats(spark):
    rows = [(1, 0, "user", "Hi <there> \\ <|end|>\n"), (1, 1, "assistant", None), (1, 2, "assistant", "\\<|turn|> user <|says|> x <|end|>\n"), (2, 1, None, ""), (2, 1, None, ""), (3, 5, "sy: <|says|> s", "😀 é \\"), (3, 4, "assistant", "<" * 50)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    chats = chat.format_chats(df)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.digests(chats).collect()}
    assert got == brute.chats(rows)
    for r in chats.collect():
        assert r["formatted"].count(chat.END) == len(r["turns"]) == r["formatted"].count(chat.HEAD)
    assert chat.format_chats(df.limit(0)).count() == 0


def test_long_chats(spark):
    """Many turns and long turns: places over several groups and stretches, with wide characters, empty texts and marks."""
    said = ["", "a|b\\", "é中😀" * 400, chat.SAYS + chat.END + chat.HEAD, "x" * chat.STRETCH, "😀"]
    rows = [(c, t, "user" if t % 2 else "assistant", said[(t * t + c) % len(said)]) for c, n in ((1, 700), (2, chat.GROUP), (3, 1), (4, chat.GROUP + 1)) for t in range(n)]
    chats = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.digests(chats).collect()}
    assert got == brute.chats(rows)
    for r in chats.collect():
        for t in r["turns"]:
            assert t["text"] == re.sub(r"(?s)\\(.)", r"\1", r["formatted"][t["start"] : t["end"]])


def test_chat_layouts(spark):
    df = spark.createDataFrame([(1, [("user", "a"), ("assistant", None)], "z")], "conv_id long, messages array<struct<role:string,content:string>>, extra string")
    assert chat.layout_of(df.schema) == "messages"
    assert [tuple(t) for t in chat.canonical_turns(df).first()["turns"]] == [("user", "a"), ("assistant", "")]
    for lost in ("other string", "prompt string, completion string, response string", "messages array<struct<role:string,content:string>>, prompt string", "instruction string, output string, prompt string"):
        with pytest.raises(ValueError):
            chat.layout_of(spark.createDataFrame([], f"conv_id long, {lost}").schema)
    assert chat.layout_of(spark.createDataFrame([], "prompt string, turn long, completion string, id long").schema) == "completion"
    texts = [
        '{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"r"}],"meta":1}', '{"conversations":[{"from":"human","value":"h"}]}',
        '{"prompt":"p","completion":"c"}', '{"prompt":"p","response":"s"}', '{"instruction":"i","input":"n","output":"o"}', '{"instruction":"i","output":"o"}', '{"what":1}', "not json", None,
    ]
    out = chat.canonical_json(spark.createDataFrame(list(enumerate(texts)), "id long, body string"), "body", "id").orderBy("id").collect()
    assert [r["layout"] for r in out] == ["messages", "shared", "completion", "response", "instruction_input", "instruction", "unmapped", "unmapped", "unmapped"]
    assert [[tuple(t) for t in r["turns"]] for r in out[:6]] == [[("user", "q"), ("assistant", "r")], [("human", "h")], [("user", "p"), ("assistant", "c")], [("user", "p"), ("assistant", "s")], [("user", "i\nn"), ("assistant", "o")], [("user", "i"), ("assistant", "o")]]


def test_json_chats_of_other_inner_keys_are_unmapped(spark):
    texts = {
        '{"messages":[{"from":"human","value":"hello"}]}': "unmapped",
        '{"conversations":[{"role":"user","content":"hello"}]}': "unmapped",
        '{"messages":[{"role":"user","content":"q"},{"from":"gpt","value":"a"}]}': "unmapped",
        '{"messages":[{"role":"user","content":"q"},"a"]}': "unmapped",
        '{"messages":[{"role":"user","text":"q"}]}': "unmapped",
        '{"messages":[{"role":"user"}]}': "unmapped",
        '{"messages":"hello"}': "unmapped",
        '{"messages":[{"role":"user","content":"q","from":"x"},{"role":"assistant"},null]}': "messages",
        '{"messages":[]}': "messages",
        '{"conversations":[{"from":"human","value":"h","id":3},{"value":"a","from":"gpt"}]}': "shared",
    }
    out = chat.canonical_json(spark.createDataFrame(list(enumerate(texts)), "id long, body string"), "body", "id").orderBy("id").collect()
    assert [r["layout"] for r in out] == list(texts.values())
    assert all(r["turns"] is None for r in out if r["layout"] == "unmapped")
    assert [[tuple(t) for t in r["turns"]] for r in out[-3:]] == [[("user", "q"), ("assistant", ""), ("", "")], [], [("human", "h"), ("gpt", "a")]]


def test_gif_files(docs, rows, empty):
    got = held(gif.text_media(docs), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "media")
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        n, size, digest, crc, m, m_digest, media = got[i]
        assert (n, size, digest, crc, m, m_digest) == (len(raw), len(payload), brute.sha(payload), zlib.crc32(payload[-64:]), len(media), brute.sha(bytes(media)))
        assert gif.load(bytes(media)) == payload
    assert gif.text_media(empty).count() == 0


def test_gif_features_are_of_rendered_frames(spark, monkeypatch):
    """Of a file with own palettes, as its pixels are seen, not as its indices are; and of texts in several frames."""
    pal = np.zeros((256, 3), np.uint8)
    pal[1], pal[2] = (255, 0, 0), (0, 255, 0)
    data = gif.encode([gif.Frame(np.ones((2, 2), np.uint8), delay=5), gif.Frame(np.array([[2, 0]], np.uint8), delay=7, transparent=0)], 2, 2, pal)
    assert gif.seen(data) == (bytes([255] * 4 + [0, 255]), f"2:5,7:{15 * 16}=1,{15 * 256}=7")
    df = spark.createDataFrame([(1, "0" * 64 * 1024 + "A" * 64), (2, None)], "doc_id long, text string")
    got = held(gif.text_media(df), "feature")
    assert got == {1: (f"2:10,10:{3 * 273}={64 * 2047},{4 * 273}=64",), 2: ("1:10:0=64",)}
    assert gif.seen(gif.encode([gif.Frame(np.zeros((1, 1), np.uint8))], 1, 1, gif.GREY[::-1])) == (b"\xff", "1:0:4095=1")


def plain_feature(payload):
    """Of a payload as frames of 64 x 1024 greys, each counted over the whole canvas that it leaves."""
    shots, canvas = [], bytearray(min(len(payload), 65536))
    for i in range(0, len(payload), 65536):
        part = payload[i : i + 65536]
        canvas[: len(part)] = part
        shots.append(bytes(canvas))
    cells = Counter(b // 16 * 273 for s in shots for b in s)
    return f"{len(shots)}:{','.join(['10'] * len(shots))}:{','.join(f'{k}={cells[k]}' for k in sorted(cells))}"


def test_gif_features_of_all_texts(docs, rows):
    got = held(gif.text_media(docs, keep_media=False), "feature")
    for i, t in rows:
        raw = (t or "").encode()
        assert got[i][0] == plain_feature(raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0"))


def test_gif_oddities(spark):
    """Files without frames, with a huge screen or frame, cut short; null ids and repeated rows of texts."""
    empty = gif.encode([], 2, 2)
    screen = empty[:6] + b"\xff\xff\xff\xff" + empty[10:]
    one = gif.encode([gif.Frame(np.ones((2, 2), np.uint8))], 2, 2)
    wide = one.replace(b"\x2c" + bytes(4) + b"\2\0\2\0", b"\x2c" + bytes(4) + b"\xff\xff\xff\xff")
    assert wide != one
    df = spark.createDataFrame([(1, empty), (2, screen), (3, wide), (4, one[:-8]), (5, one), (5, one)], "id long, media binary")
    got = gif.gif_frames(df, "media", "id").collect()
    assert {r["id"]: r["error"] is None for r in got} == {1: False, 2: False, 3: False, 4: False, 5: True} and len(got) == 6
    df = spark.createDataFrame([(None, "x"), (None, "x"), (7, "x"), (7, "x")], "doc_id long, text string")
    got = gif.text_media(df).collect()
    assert len(got) == 4 and len({r["media_sha256"] for r in got}) == 1 and sum(r["doc_id"] is None for r in got) == 2


def test_gif_rendering(spark):
    """Disposal, transparency, own palettes and interlace."""
    pal = np.zeros((256, 3), np.uint8)
    pal[1], pal[2] = (255, 0, 0), (0, 255, 0)
    a = gif.Frame(np.ones((4, 4), np.uint8), delay=5)
    b = gif.Frame(np.array([[2, 0], [0, 2]], np.uint8), 1, 1, 7, 3, 0)
    c = gif.Frame(np.full((2, 2), 1, np.uint8), 0, 0, 1, 2, None, np.roll(pal, 1, 0))
    data = gif.encode([a, b, c, gif.Frame(np.full((1, 1), 2, np.uint8), 3, 3)], 4, 4, pal)
    shots = list(gif.render(data))
    assert [(s, d) for s, d, _ in shots] == [(0, 5), (5, 7), (12, 1), (13, 0)]
    red, green = [255, 0, 0], [0, 255, 0]
    assert shots[1][2][1, 1].tolist() == green and shots[1][2][1, 2].tolist() == red
    assert shots[2][2][1, 1].tolist() == [0, 0, 0] and shots[2][2][2, 2].tolist() == red
    assert shots[3][2][0, 0].tolist() == [0, 0, 0] and shots[3][2][3, 3].tolist() == green
    df = spark.createDataFrame([(1, data), (2, None), (3, b"GIF89a")], "id long, media binary")
    frames = gif.gif_frames(df, "media", "id").orderBy("id", "frame").collect()
    assert len(frames) == 6 and sum(frames[0]["histogram"]) == 16 and frames[4]["error"] and frames[5]["error"]
    # A stream of another encoder's making: 2-bit samples 0 1 0 1 with codes of 3 bits: clear 0 1 6 end.
    bits = "".join(format(c, "03b")[::-1] for c in (4, 0, 1, 6, 5))
    assert gif.lzw_decode(bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8)), 2) == b"\0\1\0\1"


def test_personal_spans(docs, rows, empty):
    got = held(pii.find(docs), "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    for i, t in rows:
        base = brute.personal(t)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        count = tuple(sum(k == x for k, _, _ in base) for x in pii.BASE_KINDS)
        assert got[i][:5] == (*count, brute.sha(text))
        assert got[i][5].startswith(text)
    assert any("secret" in x[5] for x in got.values())
    assert pii.find(empty).count() == 0
    cleaned = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert cleaned[0] is None and "[EMAIL]" in "".join(x for x in cleaned.values() if x)


@pytest.mark.parametrize("seed", range(6))
def test_base_spans_of_random_strings(seed):
    r = random.Random(seed)
    for _ in range(500):
        t = "".join(r.choices("a_+-.@ 1240(%)é", k=r.randint(0, 60)))
        assert pii.base_spans(t) == brute.personal(t)


def test_base_spans_of_long_runs():
    """A number of thousands of digits is no crash, and a run is walked once however long it is."""
    t = "1.1.1." + "0" * 5000 + "1"
    assert pii.base_spans(t) == [("ip", 0, len(t))]
    assert pii.base_spans("1.1.1." + "9" * 5000) == []
    model = pii.train()
    began = time.monotonic()
    for t in ("1" * 10**6, "a" * 10**6 + "@", "a@" * 300_000, "1." * 300_000, "x" * 10**6 + " (at) b 1", " ".join(f"a{i}b{i}cdef" for i in range(30_000))):
        base = pii.base_spans(t)
        pii.more_spans(t, base, model)
    assert time.monotonic() - began < 60
    for n in (10, 40, 300):
        for t in ("1" * n, "a" * n + "@", "a@" * n + "b.c", "1." * n, "7-" * n + "1", "+" + "1" * n + "(" * n, ("1.1.1 " * n)):
            assert pii.base_spans(t) == brute.personal(t)


def test_added_spans_lie_apart(monkeypatch):
    r = random.Random(6)
    model = pii.train()
    for _ in range(40):
        spans = [(r.choice(pii.MORE_KINDS), a, a + r.randint(1, 9)) for a in r.choices(range(100), k=30)]
        base = [("ip", a, a + r.randint(1, 5)) for a in r.choices(range(100), k=4)]
        score = {s: r.random() for s in spans}
        monkeypatch.setattr(pii, "candidates", lambda _, spans=spans: spans)
        monkeypatch.setattr(pii, "features", lambda _, *s, score=score: [score[s]])
        monkeypatch.setattr(pii.Trees, "probability", lambda _, x: x[:, 0])
        want = []
        for s in sorted(spans, key=lambda s: -score[s]):
            if score[s] >= model.thresholds[s[0]] and all(s[2] <= b[1] or s[1] >= b[2] for b in base + want):
                want.append(s)
        assert pii.more_spans("x", base, model) == sorted(want, key=lambda s: (pii.KINDS.index(s[0]), s[1]))


def test_added_spans_on_documents():
    """Of the secrets planted in the test documents all are found, and nothing else is added."""
    import pyarrow.parquet as pq

    model, planted, found = pii.train(), set(), set()
    for i, t in zip(*pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text"]).to_pydict().values(), strict=True):
        planted |= {(i, *m.span(1)) for m in re.finditer(r"(?i)token = \"([0-9a-f]{40})\"", t or "")}
        found |= {(i, a, b) for _, a, b in pii.more_spans(t or "", pii.base_spans(t or ""), model)}
    assert len(planted) > 100
    assert len(planted & found) >= 0.97 * len(planted) and len(planted & found) >= 0.97 * len(found)


def test_personal_spans_of_null_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "a@b.co"), (None, None), (4, "a@b.co"), (4, "a@b.co")], "doc_id long, text string")
    assert sorted(((r["doc_id"], r["spans"], r["n_spans"]) for r in pii.find(df).collect()), key=str) == [(4, "email:0:6", 1), (4, "email:0:6", 1), (None, "", 0), (None, "email:0:6", 1)]


def test_trees_hold_on_new_examples():
    model = pii.train()
    made = pii.examples(2000, 99)
    p = model.probability(np.array([pii.features(*e[:4]) for e in made]))
    y = np.array([e[4] for e in made])
    told = np.array([v >= model.thresholds[e[1]] for v, e in zip(p, made, strict=True)])
    assert (told == y).mean() > 0.95 and y[told].mean() > 0.95


def test_licenses(docs, rows, empty):
    got = held(license.scan(docs), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    for i, t in rows:
        want = brute.licenses(t)
        assert got[i][:5] == want
        assert set(filter(None, want[4].split(","))) <= set(got[i][5].split(",")) and 0 <= got[i][6] <= 1
    assert license.scan(empty).count() == 0


def plain_blocks(text):
    """label -> largest share of a template's words in as many consecutive words as it has, where enough."""
    words, out = license.words_of(text), {}
    for label, template in license.TEMPLATES.items():
        own, n = set(license.words_of(template)), len(license.words_of(template))
        best = max((len(own & set(words[i : i + n])) for i in range(len(words))), default=0)
        if 10 * best >= 9 * len(own):
            out[label] = best / len(own)
    return out


def test_wrapped_licenses(spark):
    """Notices that wrap at any width, also behind comment marks, are met; their words dealt over a text or a long line are not."""
    rows, want = [], []
    for label, text in license.TEMPLATES.items():
        for width in (20, 72):
            for mark in ("", " * ", "# "):
                rows.append((len(rows), "x = 1\n" + "\n".join(mark + x for x in textwrap.wrap(text, width)) + "\nand so on\n"))
                want.append((label, True))
        rows.append((len(rows), " ".join(f"{w} then other words that say nothing here" for w in text.split())))
        want.append((label, False))
    rows.append((len(rows), "the public said that under a general licensed driver gnu animals lesser kudu need a license to graze and apache 2 helicopters version 0"))
    want.append((None, False))
    got = license.scan(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    for (_, text), r, (label, there) in zip(rows, got, want, strict=True):
        blocks = plain_blocks(text)
        assert set(filter(None, r["labels"].split(","))) == {*blocks, *filter(None, r["base_labels"].split(","))}
        assert r["score"] == (1.0 if r["n_base"] else max(blocks.values(), default=0.0))
        assert {b["label"]: b["containment"] for b in sorted(r["blocks"], key=lambda b: b["containment"])} == blocks
        if there:
            assert blocks[label] == 1 and [b["word"] for b in r["blocks"] if b["label"] == label] == [2]
        elif label:
            assert label not in blocks or len(license.words_of(license.TEMPLATES[label])) < 3
        else:
            assert not blocks


def test_long_lines_are_scanned(spark):
    text = "the license of the software is " * 20_000 + license.TEMPLATES["mit-text"] + " and the software " * 20_000
    got = license.scan(spark.createDataFrame([(None, text), (None, text), (1, None)], "doc_id long, text string")).collect()
    assert [r["labels"] for r in got if r["doc_id"] is None] == ["mit-text"] * 2 and sum(r["labels"] == "" for r in got) == 1


@pytest.mark.parametrize("seed", range(3))
def test_containment_join_is_exact(seed):
    r = random.Random(seed)
    names = [f"t{i}" for i in range(30)]
    templates = {f"l{k}": " ".join(r.sample(names, r.randint(1, 12))) for k in range(25)}
    counts = {n.encode(): r.randint(0, 9) for n in names}
    for threshold in (0.5, 0.75, 0.9, 1.0):
        index = license.ContainmentIndex(templates, counts, threshold)
        for _ in range(100):
            block = [x.encode() for x in r.choices(names, k=r.randint(0, 30))]
            want = {(x, len(set(block) & set(license.words_of(t))) / len(set(license.words_of(t)))) for x, t in templates.items()}
            assert set(index.matches(block)) == {(x, s) for x, s in want if s >= threshold - 1e-9}


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.public_vocabulary()


def test_bpe_like_the_public_library(docs, rows, empty, vocabulary):
    import tiktoken

    path, pattern = vocabulary
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    want = {i: enc.encode_ordinary(t or "") for i, t in rows}
    got = held(bpe.round_trip(docs, path, pattern), "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == {i: (len(want[i]), brute.sha(" ".join(map(str, want[i]))), brute.sha((t or "").encode())) for i, t in rows}
    ids = bpe.encode(docs, path, pattern)
    assert {r["doc_id"]: list(r["ids"]) for r in ids.collect()} == want
    assert {r["doc_id"]: bytes(r["bytes"]) for r in bpe.decode(ids, path, pattern).collect()} == {i: (t or "").encode() for i, t in rows}
    assert bpe.round_trip(empty, path, pattern).count() == 0
    codec = bpe.codec(path, pattern)
    r = random.Random(8)
    for _ in range(300):
        t = "".join(r.choices("abcdeTHE  \t\n\r\x1c\x85 　'stréßñ中0129²½😀!@#._-​", k=r.randint(0, 60)))
        assert codec.encode([t])[0].tolist() == enc.encode_ordinary(t)
    want = [enc.encode_ordinary(t) for t in ("a" * 70_000, "é" * 9000, " " * 5000, "!?" * 3000, "12345" * 900, "xyz" * 66, "q" * 200, "q" * 201)]
    assert [x.tolist() for x in codec.encode(["a" * 70_000, "é" * 9000, " " * 5000, "!?" * 3000, "12345" * 900, "xyz" * 66, "q" * 200, "q" * 201])] == want


def test_decoding_is_of_the_ids(vocabulary, monkeypatch):
    """What is decoded comes from the ids, in stretches too, not from the text."""
    codec = bpe.codec(*vocabulary)
    ids = codec.encode(["one two three", "", "four"])
    monkeypatch.setattr(bpe, "DECODED", 2)
    assert codec.decode_ids(ids) == [b"one two three", b"", b"four"]
    assert codec.decode_ids([ids[0][::-1].copy()])[0] != b"one two three"
    assert codec.db.sql("SELECT current_setting('temp_directory')").fetchall()[0][0] in ("", None)


def test_bpe_remembers_pieces_across_tasks(vocabulary, monkeypatch):
    """A query's later tasks learn only new pieces; pieces that recur stay when the memory is full; another query begins anew."""
    codec, learnt = bpe.Codec(bpe.load_ranks(vocabulary[0]), vocabulary[1]), []
    contract = codec.contract
    monkeypatch.setattr(codec, "contract", lambda raw: learnt.extend(raw) or contract(raw))

    def task(query, text):
        learnt.clear()
        codec.begin(query)
        ids = codec.encode([text])
        codec.rest()
        assert codec.decode_ids(ids) == [text.encode()]
        return sorted(learnt)

    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    assert task("a", "blorp zwick") == [b" zwick", b"blorp"]
    assert task("a", "blorp zwick quaff") == [b" quaff"]
    assert task("a", "blorp fnord") == [b" fnord"]
    assert task("a", "blorp fnord") == []
    assert task("a", "glomp glomp glomp snark wibbl")[0] == b" glomp" and len(codec.known) + len(codec.older) <= 8
    assert task("b", "blorp zwick") == [b" zwick", b"blorp"]


def test_bpe_of_null_ids_and_carried_columns(spark, vocabulary):
    df = spark.createDataFrame([(None, "a b", 5), (None, None, 6), (3, "x" * 5000, None), (3, "x" * 5000, None)], "doc_id long, text string, position int")
    got = sorted(((r["doc_id"], r["n_tokens"] > 0, r["position"]) for r in bpe.round_trip(df, *vocabulary, carry="position").collect()), key=str)
    assert got == sorted([(None, True, 5), (None, False, 6), (3, True, None), (3, True, None)], key=str)


def test_quality_on_the_held_out_fold(spark):
    d = "/root/testdata/sf0.01"
    df, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = quality.score(df, quality.train(df, labels)).join(labels, "doc_id").where("held_out").collect()
    s, y = np.array([r["score"] for r in got]), np.array([r["quality"] for r in got])
    assert ((s >= 0.3) == y).mean() > 0.93
    assert np.mean([a > b for a in s[y == 1] for b in s[y == 0]]) > 0.97


def test_quality_edge_cases(docs, rows, empty, spark, monkeypatch):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.train(docs, none).score(b"x") == 0.5
    some = spark.createDataFrame([(r[0], k % 2, "x") for k, r in enumerate(rows)] + [(None, 1, "x"), (3, None, "y")], "doc_id long, quality int, text string")
    net = quality.train(docs, some)
    got = held(quality.score(docs, net), "held_out", "score", "predicted")
    assert all(x[0] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= x[1] <= 1 and x[2] == (x[1] >= 0.3) for i, x in got.items())
    assert quality.score(empty, net).count() == 0
    assert quality.keep_good(docs, net).count() == sum(x[2] for x in got.values())
    many = spark.createDataFrame([(k % 2, f"{k % 2} {k}") for k in range(400)], "doc_id long, text string")
    one = spark.createDataFrame([(0, 1), (1, 0), (1, 0)], "doc_id long, quality int")
    seen: list = []
    monkeypatch.setattr(quality, "fit", lambda rows: seen.extend(rows))
    monkeypatch.setattr(quality, "fold", lambda c: c * 0 + 1)
    quality.train(many, one, sample=30)
    assert Counter((t[:1], y) for t, y in seen) == {(b"0", 1): 30, (b"1", 0): 30}


def plain_score(net, text):
    """The network from its description, place by place."""
    data = text + bytes(-len(text) % 128 if len(text) > 256 else 256 - len(text)) + bytes(8)
    size = len(data) - 8
    at = {p: sum(net.tables[k][data[p + k]].astype(float) for k in range(4)) for p in range(0, size, 2)}
    chunks = [np.max([at[p] for p in range(c, c + 256, 2)], 0) for c in range(0, max(size - 128, 1), 128)]
    c = np.tanh(np.array(chunks))
    return 1 / (1 + np.exp(-(np.concatenate([c.mean(0), c.max(0)]) @ net.weights + net.bias)))


def test_scores_are_of_all_chunks():
    r, net = random.Random(9), quality.Network()
    for n in (0, 1, 255, 256, 257, 384, 385, 1000, 5000):
        text = bytes(r.choices(range(256), k=n))
        assert np.isclose(net.score(text), plain_score(net, text), atol=1e-5)
    batch, net = [(bytes(r.choices(b"abc", k=60_000)) + b"#" * 300, 1, 1.0), (bytes(r.choices(b"abc", k=60_000)), 0, 1.0)], quality.Network()
    state: dict = {}
    for _ in range(60):
        net.step(batch, 0.02, state)
    assert net.score(batch[0][0]) > 0.8 > 0.3 > net.score(batch[1][0])


def test_gradient_follows_the_loss():
    """A step lowers the loss of its batch."""
    r = random.Random(3)
    batch = [(bytes(r.choices(b"abc", k=700)), 1, 1.0) for _ in range(6)] + [(bytes(r.choices(b"ABC", k=300)), 0, 1.0) for _ in range(6)]
    net, state = quality.Network(), {}
    loss = lambda: -np.mean([np.log(net.score(t) if y else 1 - net.score(t)) for t, y, _ in batch])
    before = loss()
    for _ in range(30):
        net.step(batch, 0.02, state)
    assert loss() < before / 2


def test_neighbours(spark):
    r = np.random.default_rng(0)
    centres = r.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.6 * r.normal(size=16)).tolist()) for i in range(3000)]
    rows += [(5000 + i, rows[100][1]) for i in range(40)]
    odd = [(9000, None), (9100, [0.0] * 16), (9200, [float("nan")] * 16), (9300, [1.0]), (9400, []), (9500, [None] * 16), (None, [1.0] * 16), (9600, [float("inf")] * 16)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + odd], "vec_id long, embedding array<float>, id int, v string")
    rows = [(i, np.array(v, np.float32).astype(float)) for i, v in rows]
    want, got = brute.neighbours(rows), {}
    for x in ann.search(df).orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append((x["vec_id"], x["score"]))
    assert set(got) == set(want)
    right = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / sum(map(len, want.values()))
    assert right >= 0.9
    exact = dict(rows)
    for q, found in got.items():
        assert len(found) == 10 and found == sorted(found, key=lambda x: (x[1], x[0]))
        assert all(np.isclose(d, np.linalg.norm(exact[q] - exact[i]), rtol=1e-12) for i, d in found)
    assert got[100] == [(5000 + i, 0.0) for i in range(10)]
    few = ann.search(df.where("vec_id in (0, 1, 2, 3)")).collect()
    assert sorted(x["vec_id"] for x in few) == [1, 2, 3]
    assert ann.search(df.limit(0)).count() == 0


def test_hot_cells_are_split(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 50)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 3)
    rows = [(i, [1.0, 2.0, 3.0, 4.0, 5.0]) for i in range(600)] + [(600 + i, [float(i), 1.0, 1.0, 1.0, 1.0]) for i in range(200)]
    got: dict = {}
    for x in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append((x["vec_id"], x["score"]))
    assert got == brute.neighbours(rows)


def test_repeated_ids_and_lengths_of_vectors(spark):
    """Every row but the query's own is a candidate; vectors of a rare length have neighbours of that length."""
    data = [(100, [1.0, 0.0]), (100, [1.0, 0.0]), (100, [0.0, 5.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0]), (200, [1.0, 2.0, 3.0]), (8, [1.0, 2.0, 4.0]), (300, [1.0])]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in ann.search(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect())
    want = []
    for k, (i, v) in enumerate(data):
        if i % 100 == 0:
            near = sorted((np.linalg.norm(np.subtract(v, w)), j) for m, (j, w) in enumerate(data) if m != k and len(w) == len(v))
            want += [(i, n + 1, j, round(float(d), 9)) for n, (d, j) in enumerate(near[:10])]
    assert got == sorted(want)


def test_share_follows_the_structure():
    r = np.random.default_rng(3)
    centres = r.normal(size=(60, 16)) * 20
    close = centres[r.integers(0, 60, 4000)] + r.normal(size=(4000, 16))
    assert ann.Index(close, 4000).share < 0.1 < ann.Index(r.normal(size=(4000, 16)), 4000).share
    index = ann.Index(close, 4000)
    cell, codes = index.encode(close[:50])
    for q in close[50:60]:
        flat = codes + np.arange(codes.shape[1]) * ann.CODES
        d = ((index.cells[cell] - q) ** 2).sum(1) + index.constants(cell, codes) + index.table(q).ravel()[flat].sum(1)
        coded = index.cells[cell] + np.concatenate([b[codes[:, k]] for k, b in enumerate(index.books)], 1)
        assert np.allclose(d, ((coded - q) ** 2).sum(1))


def test_every_operator_has_a_query():
    names = queries.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10


@pytest.mark.parametrize("checkpoint", [session.checkpoint, common.checkpoint])
def test_checkpoints_give_the_heap_back(spark, monkeypatch, checkpoint):
    """Only beyond the share of the heap that is allowed."""
    calls = []
    monkeypatch.setattr(session.gc, "collect", lambda: calls.append(1))
    for share, n in ((1.0, 0), (0.0, 1)):
        monkeypatch.setattr(session, "HEAP_SHARE", share)
        assert checkpoint(spark.range(10)).count() == 10
        assert len(calls) == n
