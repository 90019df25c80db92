"""Text operators against plain versions, round trips and held-out accuracy."""

import base64
import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from patchframe.llm import archive, bpe, chat, jaccard, mixing, repeats, toxicity
from patchframe.llm.suffixes import suffix_array
from patchframe.llm.words import hashes, tokens

NAMES = "id long, name string, k string, t string, score double, own int, c string"


def names(spark, rows):
    """Annotations with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "k", "t", 1.0, 2, "c") for i, t in rows], NAMES)


# --- encoding ------------------------------------------------------------------------

@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def plain(ranks):
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


@pytest.mark.parametrize("chunk,overlap", [(97, 16), (300, 40), (100_000, 8)])
def test_encoding_is_the_library_s_and_decodes(spark, ranks, plain, chunk, overlap):
    rng = random.Random(3)
    parts = ["a", "b ", "  ", "\n", "\n\n", "'s", "'re", "é", "日本", "1", "!!", " ", "tion", "x'", "\t", "🙂", "z" * 40, "<|endoftext|>"]
    texts = ["", None, "a" * 500, "  " * 300] + ["".join(rng.choices(parts, k=rng.randint(1, 400))) for _ in range(120)]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[9]), (3, texts[5])]
    got = bpe.decode(bpe.encode(names(spark, rows), ranks, public_tokenizers.PATTERN, chunk_chars=chunk, overlap_chars=overlap), ranks)
    assert got.columns == ["id", "ids", "n_tokens", "body"]
    want = sorted((str(i), np.array(plain.encode_ordinary(t or ""), dtype="<u4").tobytes(), (t or "").encode()) for i, t in rows)
    assert sorted((str(r.id), bytes(r.ids), bytes(r.body)) for r in got.collect()) == want
    both = bpe.encode(names(spark, rows), ranks, public_tokenizers.PATTERN, chunk_chars=chunk, overlap_chars=overlap, decoded=True)
    assert sorted((str(r.id), bytes(r.ids), bytes(r.body)) for r in both.collect()) == want


def test_encoding_nothing(spark, ranks):
    assert bpe.encode(names(spark, []), ranks, public_tokenizers.PATTERN).count() == 0


def test_long_words_merge_as_short_ones_do(ranks, plain):
    table, _, _ = bpe._table(ranks)
    for word in (b"aaaaaaaaab" * 300, "ßü".encode() * 200, b"x"):
        assert bpe.merge_word(word, table) == plain._encode_single_piece(word.decode())


# --- repeated passages -----------------------------------------------------------------

def test_suffix_array_by_linear_grouping():
    rng = random.Random(1)
    for _ in range(400):
        t = []
        for _ in range(rng.randint(1, 5)):
            t += [rng.randint(1, rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(0, 14))] + [0]
        ends = t.count(0)
        unique, seen = [], 0
        for x in t:
            unique.append(x + ends if x else seen)
            seen += x == 0
        assert suffix_array(np.array(t)).tolist() == sorted(range(len(t)), key=lambda i: unique[i:])
    assert suffix_array(np.zeros(0, int)).tolist() == []


def plain_repeats(rows, n):
    first = {}
    for i, t in sorted(rows):
        for p in range(len(t) - n + 1):
            first.setdefault(t[p:p + n], i)
    out = {}
    for i, t in rows:
        hit = bytearray(len(t))
        for p in range(len(t) - n + 1):
            if first[t[p:p + n]] < i:
                hit[p:p + n] = b"\1" * n
        out[i] = (sum(hit), sum(1 for p in range(len(t)) if hit[p] and (not p or not hit[p - 1])), bytes(c for c, x in zip(t, hit) if not x))
    return out


@pytest.mark.parametrize("length,crowd", [(50, 4096), (50, 1), (11, 3)])
def test_repeats_against_every_window(spark, length, crowd):
    rng = random.Random(4)
    passages = ["".join(rng.choices("abc dé", k=rng.randint(length - 10, 3 * length))) for _ in range(8)]
    rows = {}
    for i in range(150):
        rows[rng.choice([i, -i])] = "".join(
            rng.choice([rng.choice(passages), "".join(rng.choices("abcdefgh é", k=rng.randint(1, 80))), "x" * rng.randint(1, 120)]) for _ in range(rng.randint(0, 6)))
    df = names(spark, [*rows.items(), (None, passages[0] * 2), (7000, None), (7001, "")])
    got = {r.id: r for r in repeats.remove_repeats(df, length, crowd=crowd, keep=["k", "t"]).collect()}
    want = plain_repeats([(i, t.encode()) for i, t in rows.items()] + [(7000, b""), (7001, b"")], length)
    assert {i: (got[i].n_removed, len(got[i].spans), bytes(got[i].kept)) for i in want} == want
    assert got[None].n_removed == 0 and got[7000].n_bytes == 0 and got[7001].t == "t"


def test_repeats_keep_characters_whole(spark):
    a = "é" * 60
    rows = [(1, a), (2, "xx" + a[:41] + "yy"), (2, "xx" + a[:41] + "yy")]
    got = repeats.remove_repeats(names(spark, rows), 51, whole_characters=True).where("id = 2").collect()
    assert len(got) == 2 and all(bytes(r.kept).decode().startswith("xx") for r in got)
    assert repeats.remove_repeats(names(spark, [])).count() == 0


def test_repeats_refuse_lengths_that_would_wrap(spark):
    fits = [n for n in range(4, 600) if n - repeats.gram_size(n) + 1 <= 255]
    assert fits == [*range(4, 383), *range(384, 511)]
    for length in (3, 383, 600):
        with pytest.raises(ValueError):
            repeats.remove_repeats(names(spark, [(1, "a")]), length)


# --- similar texts ------------------------------------------------------------------------

def plain_links(rows, n, threshold):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = frozenset(tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()
    ids, links, root = sorted(sets), collections.Counter(), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (links[i], find(i)) for i in ids}


@pytest.mark.parametrize("small,block", [(48, 384), (3, 5)])
def test_similar_texts_against_all_pairs(spark, small, block):
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghij", k=4)) for _ in range(300)]
    common = rng.choices(words, k=30)
    rows = [(900, ""), (901, None), (902, "one two"), (903, "One  two"), (904, "\n")]
    for g in range(40):
        base = rng.choices(words, k=rng.randint(20, 120))
        if g % 3 == 0:
            base = base[:10] + common + base[10:]
        for c in range(rng.choice([1, 1, 2, 25 if g == 0 else 4])):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((len(rows), " ".join(own)))
    df = names(spark, [*rows, (None, rows[7][1])])
    got = {r.id: (r.n_links, r.component_id) for r in jaccard.similar_texts(df, small=small, block=block).collect()}
    assert got.pop(None) == (0, None)
    assert got == plain_links(rows, 5, 0.8)


def test_similar_texts_of_large_buckets_are_not_lost(spark):
    # Groups of four with 32 of 36 n-grams in common, each more than a bucket may hold unsplit.
    rows = [(4 * k + i, " ".join([*(f"g{k}w{j}" for j in range(36)), *(f"g{k}i{i}x{j}" for j in range(4))])) for k in range(2000) for i in range(4)]
    got = jaccard.similar_texts(names(spark, rows), 5, 0.8, small=3).collect()
    assert len(got) == len(rows)
    assert sum(r.n_links for r in got) >= 0.9996 * 3 * len(rows)
    assert sum(r.component_id == r.id // 4 * 4 for r in got) >= 0.9996 * len(rows)


def test_similar_repeated_rows_and_nothing(spark):
    got = jaccard.similar_texts(names(spark, [(5, "a b c d e f"), (5, "a b c d e f"), (4, "other words here in this one")])).collect()
    assert sorted((r.id, r.n_links, r.component_id) for r in got) == [(4, 0, 4), (5, 1, 5), (5, 1, 5)]
    assert jaccard.similar_texts(names(spark, [])).count() == 0
    assert jaccard.runs_for(0.9996) == 8


# --- archive -----------------------------------------------------------------------------

def test_archive_round_trip(spark, tmp_path):
    big = "<p>é</p>" * 200
    rows = [(1, "http://a", big), (2, None, big), (3, "x\r\ny", "small"), (4, "u", "small"), (5, "e", None), (6, "e", ""), (7, "v", big), (None, "n", big)]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "capture_id long, uri string, body string, id int, sha256 string")
    folder = archive.write_archive(df, str(tmp_path / "a"))
    records = archive.read_archive(spark, folder)
    got = {r.id: r for r in records.collect()}
    for i, uri, body in rows:
        payload = (body or "").encode()
        r = got[i]
        assert bytes(r.payload) == payload and r.n_bytes == len(payload) and r.sha1 == hashlib.sha1(payload).hexdigest()
        assert (r.type, r.refers_to) == (("revisit", 7) if body == big and i != 7 else ("response", None))
    assert spark.read.parquet(folder + "/payloads").count() == 3
    one = bytes(archive.record_bytes(records).where("id = 3").first().record)
    assert one.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and one.endswith(b"\r\n\r\nsmall\r\n\r\n") and b"x%0D%0Ay" in one
    nothing = archive.write_archive(df.limit(0), str(tmp_path / "b"))
    assert archive.read_archive(spark, nothing).count() == 0


def test_archive_refuses_a_payload_that_is_not_its_digest(spark, tmp_path):
    folder = archive.write_archive(spark.createDataFrame([(1, "u", "body")], "capture_id long, uri string, body string"), str(tmp_path / "a"))
    bad = spark.read.parquet(folder + "/payloads").withColumn("payload", F.lit(b"else"))
    bad.coalesce(1).write.parquet(str(tmp_path / "c/payloads"))
    spark.read.parquet(folder + "/headers").write.parquet(str(tmp_path / "c/headers"))
    with pytest.raises(Exception, match="no sound payload"):
        archive.read_archive(spark, str(tmp_path / "c")).collect()


# --- chat ----------------------------------------------------------------------------------

def test_chat_round_trip_with_parts(spark):
    texts = ["", None, "a\\b", "</s>[INST] ok [/INST]", "<|image|>\\", "[[INST]]\\</s", "日本🙂\n", "<s><s>"]
    rows = [(c, t, ("user", "assistant", None)[t % 3], texts[(c + t) % len(texts)]) for c in range(9) for t in range(c)]
    turns = spark.createDataFrame([(*r, 0, "x") for r in rows], "conv_id int, turn int, role string, text string, i int, body string")
    out = chat.format_turns(turns.select("*", chat.text_part(F.col("text")).alias("parts")))
    got = {r.conv_id: r for r in chat.read_turns(out).collect()}
    for c in range(1, 9):
        own = sorted((r for r in rows if r[0] == c), key=lambda r: r[1])
        assert [tuple(x) for x in got[c].turns] == [(r[2] or "", r[3] or "") for r in own]
        assert got[c].n_turns == len(own) and got[c].loss == "".join(r[3] or "" for r in own if r[2] == "assistant")
    formatted = {r.conv_id: r for r in out.collect()}
    for r in formatted.values():
        assert all(r.formatted[t.start:t.start + t.length].startswith("<s>[INST]") and r.formatted[t.start:t.start + t.length].endswith("</s>") for t in r.turns)


def test_chat_control_strings_split_over_parts(spark):
    split = [["<", "/s>"], ["<", "", "/", "s>"], ["a[INS", "T]b"], ["[/INST", "]<"], ["<|ima", "ge|>"], ["\\", "<s", "></s", ">\\"], ["x<", "\\/s>"]]
    part = lambda t: ("text", t, None, None)
    rows = [(i, t, "assistant", [part(x) for x in split[i]]) for i in range(len(split)) for t in range(2)]
    turns = spark.createDataFrame(rows, f"conv_id int, turn int, role string, parts array<{chat.PART}>")
    got = {r.conv_id: r for r in chat.read_turns(chat.format_turns(turns)).collect()}
    for i, texts in enumerate(split):
        whole = "".join(texts)
        assert [tuple(x) for x in got[i].turns] == [("assistant", whole)] * 2 and got[i].loss == whole * 2


def test_chat_records_attachments(spark):
    part = lambda kind, text=None, ref=None, tokens=None: (kind, text, ref, tokens)
    rows = [(1, 0, "user", [part("text", "see "), part("image", ref="a.png", tokens=256), part("text", " and <|audio|>"), part("audio", ref="b.wav", tokens=40)]),
            (1, 1, "assistant", [part("document", ref="c.pdf", tokens=9), part("text", "done"), part("text", "!")]), (1, 1, "assistant", None)]
    df = spark.createDataFrame(rows, f"conv_id int, turn int, role string, parts array<{chat.PART}>")
    r = chat.format_turns(df).first()
    assert [(a.turn, a.kind, a.ref, a.tokens) for a in r.attachments] == [(0, "image", "a.png", 256), (0, "audio", "b.wav", 40), (2, "document", "c.pdf", 9)]
    assert all(r.formatted[a.start:].startswith(chat.PLACEHOLDERS[a.kind]) for a in r.attachments) and r.n_expanded == 305
    assert chat.read_turns(chat.format_turns(df)).first().loss == "done!"
    with pytest.raises(Exception, match="unknown kind"):
        chat.format_turns(spark.createDataFrame([(1, 0, "user", [part("video")])], df.schema)).collect()
    assert chat.format_turns(df.limit(0)).count() == 0


# --- toxicity -------------------------------------------------------------------------------

def test_toxicity_on_texts_it_has_not_seen(spark):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choices("abcdefghijkl", k=rng.randint(2, 7))) for _ in range(500)]
    rows, labels = [], []
    for i in range(900):
        w = rng.choices(vocabulary, k=rng.randint(5, 80))
        bad = rng.random() < 0.25
        if bad:
            w.insert(rng.randrange(len(w)), rng.choice(["grumblewort", "Snarkle!", "zurgender", "zurgling"]))
        rows.append((i, " ".join(w), "en" if i % 2 else "de"))
        labels.append((i, int(bad)))
    df = spark.createDataFrame(rows, "id long, name string, lang string")
    L = spark.createDataFrame(labels + [(5000, 1), (None, 0), (3, None)], "id long, toxic int")
    model, cuts = toxicity.fit_toxicity(df, L.where("id < 600"))
    scored = toxicity.score_toxicity(df.withColumn("score", F.lit(7)).withColumn("k", F.lit("k")), model, cuts, lang="lang", keep=["k"])
    got = {r.id: r for r in scored.collect()}
    unseen = [(got[i].toxic, y) for i, y in labels if i >= 600]
    assert np.mean([a == b for a, b in unseen]) > 0.95
    again, _ = toxicity.fit_toxicity(df.repartition(7), L.where("id < 600"))
    assert np.array_equal(again.E, model.E) and again.shift == model.shift


def test_toxicity_odd_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (4, "word " * 250_000), (4, "x" * 300_000)], "id long, name string")
    L = spark.createDataFrame([(1, 0)], "id long, toxic int")
    model, cuts = toxicity.fit_toxicity(df.withColumn("lang", F.lit(None).cast("string")), L)
    got = toxicity.score_toxicity(df, model, cuts).collect()
    assert len(got) == 5 and all(0 <= r.score < 0.3 and r.toxic == 0 for r in got) and cuts == {}
    assert toxicity.score_toxicity(df.limit(0), model).count() == 0


def test_long_text_scores_as_its_slices_do():
    m = toxicity.Model(3)
    ids = np.random.default_rng(0).integers(1, toxicity.BUCKETS, (250_000, 3)).astype(np.int32)
    one = m.logits(*toxicity.padded(np.array([len(ids)]), ids))
    z = m.responses(m.embed(np.vstack([ids, np.zeros((2, 3), np.int32)])))[:len(ids)].max(axis=0)
    assert np.allclose(one[0], np.maximum(z + m.b, 0) @ m.v + m.c, atol=1e-4)


# --- mixing -------------------------------------------------------------------------------

def plain_rates(size, post, goal, least, rounds=20_000):
    w = size / size.sum()
    r = np.ones(len(size))
    step = 1 / np.linalg.norm((post * w[:, None]).T @ post, 2)
    for _ in range(rounds):
        r = np.maximum(least, r - step * post @ (post.T @ (w * r) - goal))
    return r


@pytest.mark.parametrize("goal,least", [([0.5, 0.5], 0.0), ([0.9, 0.3], 1.0), ([1.5, -1.0], 0.0)])
def test_rates_are_the_plain_descent_s(spark, goal, least):
    rng = np.random.default_rng(0)
    p = rng.uniform(0.05, 0.95, 30)
    size = rng.integers(1, 100, 30)
    df = spark.createDataFrame([(i, int(s), [float(a), float(1 - a)]) for i, (s, a) in enumerate(zip(size, p))], "cell int, size long, post array<double>")
    got = np.array([r.rate for r in mixing.fit_rates(df, ["a", "b"], goal, least).orderBy("cell").collect()])
    post, w = np.stack([p, 1 - p], 1), size / size.sum()
    want = plain_rates(size.astype(float), post, np.array(goal), least)
    miss = lambda r: ((post.T @ (w * r) - goal) ** 2).sum()
    assert got.min() >= least and miss(got) <= miss(want) + 1e-6
    # What is left is told, and what no rates can better.
    rows = mixing.fit_rates(df, ["a", "b"], goal, least).collect()
    assert abs(rows[0].distance - miss(got) ** 0.5) < 1e-9 and rows[0].nearest <= miss(want) ** 0.5 + 1e-9
    none = mixing.fit_rates(df.withColumn("size", F.lit(0)), ["a", "b"], goal, least).collect()
    assert {(r.rate, r.distance, r.nearest) for r in none} == {(1.0, None, None)}


def test_classes_of_unseen_rows(spark):
    """Posteriors of rows that no label speaks of name the right class."""
    rng = random.Random(8)
    words = {"warm": ["red", "rose", "rust", "coal"], "cold": ["sea", "sky", "blue", "ice"]}
    common = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choices(common + 3 * words["warm" if i % 3 else "cold"], k=rng.randint(5, 40)))) for i in range(600)]
    L = spark.createDataFrame([(i, "warm" if i % 3 else "cold") for i in range(300)], "id long, class_id string")
    got = mixing.mix_to_targets(names(spark, rows), L, {"warm": 1, "cold": 1}).where("id >= 300").collect()
    assert sum((r.post_warm > 0.5) == bool(r.id % 3) for r in got) >= 0.95 * len(got)


def test_mixing_meets_targets(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(["red", "rose", "rust"] if i % 4 else ["sea", "sky", "blue"], k=rng.randint(3, 40)))) for i in range(400)]
    df = names(spark, [*rows, (None, "sea"), (1000, None), (1001, ""), (1, rows[1][1])])
    L = spark.createDataFrame([(i, "warm" if i % 4 else "cold") for i in range(0, 400, 2)] + [(1, "other"), (None, "warm")], "id long, class_id string")
    got = mixing.mix_to_targets(df, L, {"warm": 1, "cold": 1}, keep=["k"]).collect()
    assert len(got) == 404 and min(r.rate for r in got) >= 0
    total = sum(r.size for r in got)
    for c in ("post_warm", "post_cold"):
        assert abs(sum(r.rate * r.size * r[c] for r in got) / total - 0.5) < 1e-3
    assert all((r.post_warm > 0.5) == bool(r.id % 4) for r in got if r.id is not None and r.id < 400)
    assert {r.size for r in got if r.id in (1000, 1001)} == {0}
    assert mixing.mix_to_targets(df.limit(0), L.limit(0), {"warm": 1, "cold": 1}).count() == 0


# --- words --------------------------------------------------------------------------------

def test_words_and_hashes_do_not_depend_on_place():
    texts = [b"one two", b"", b" two  one\n", b"onetwo"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    off = np.cumsum([0] + [len(t) for t in texts])
    s, e, t = tokens(data, off)
    assert [(bytes(data[a:b]), i) for a, b, i in zip(s, e, t)] == [(w, i) for i, x in enumerate(texts) for w in x.split()]
    h = hashes(data, s, e)
    assert h[0] == h[3] and h[1] == h[2] and len(set(h.tolist())) == 3


def test_toxicity_sample_is_bounded_by_words(spark):
    """Texts that would exceed the bound stay out of the fit; very long ones are never gathered."""
    rows = [(i, ("good day " if i % 2 else "vile words ") * 20 + str(i), "en") for i in range(200)] + [(900 + i, "long " * 200_000, "en") for i in range(4)]
    df = spark.createDataFrame(rows, "id long, name string, lang string")
    L = spark.createDataFrame([(i, int(i % 2 == 0)) for i, _, _ in rows], "id long, toxic int")
    model, _ = toxicity.fit_toxicity(df, L, fit_words=6000)
    got = {r.id: r.toxic for r in toxicity.score_toxicity(df.where("id < 200"), model).collect()}
    assert np.mean([got[i] == (i % 2 == 0) for i in got]) > 0.95
    none, cuts = toxicity.fit_toxicity(df, L, fit_words=10)
    assert cuts == {} and none.shift == -4.0


def test_near_copies_in_several_large_buckets_are_compared_once(spark, monkeypatch):
    """Block rows of a group of n near copies grow with n, and its links stay whole."""
    seen = {}
    real = jaccard.stage

    def stage(df, name):
        out = real(df, name)
        if name == "leaves":
            seen["rows"] = out.where("m > 48").count()
        return out

    monkeypatch.setattr(jaccard, "stage", stage)
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    for n in (100, 200):
        rows = []
        for i in range(n):
            words_ = list(base)
            words_[rng.randrange(150)] = f"x{i}"
            rows.append((i, " ".join(words_)))
        got = jaccard.similar_texts(names(spark, rows)).collect()
        assert {(r.id, r.n_links, r.component_id) for r in got} == {(i, a, b) for i, (a, b) in plain_links(rows, 5, 0.8).items()}
        assert seen["rows"] <= 2 * n
