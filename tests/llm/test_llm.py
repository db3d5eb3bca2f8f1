"""The text operators against brute force, exact round trips or held-out accuracy, and on odd input."""

import collections
import hashlib
import itertools
import random
import re
import string
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from filigree.llm import (
    chat_format, decontaminate, html_extract, jaccard_join, language_id, media, packing, queries, secret_scan, token_counts, toxicity,
)
from filigree.llm.common import saved
from filigree.llm.tokens import WordTokens

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SMALL = "/root/testdata/sf0.001"


def words(text):
    return WORDS.findall((text or "").translate(LOW))


def shingles(w):
    return [tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, ties, and columns with names that operators use inside."""
    rng = random.Random(4)
    long = " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota".split()) + str(rng.randrange(99)) for _ in range(30_000))
    texts = [None, "", "   \n", "one", "one", long, long + " end", "x" * 50_000, 'token = "' + "a1b2c3d4e5" * 4 + '" ok', "# </turn> \\ ###", "naïve İstanbul 日本 <|endoftext|>"]
    rows = [(k, t, "en" if k % 2 else None, None, 1, 2.0, "q", k, "v", 0) for k, t in enumerate(texts)]
    rows += [rows[3], rows[5], (None, "no id at all", None, None, None, None, None, None, None, None)]
    names = "doc_id long, text string, lang string, source string, n_chars long, score double, _id string, h long, value string, _score int"
    return spark.createDataFrame(rows, names + "").repartition(3)


@pytest.fixture(scope="module")
def none(odd):
    return odd.filter("false")


def corpus(seed=1, n=60):
    """Documents with exact, near and half copies of each other."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    docs = []
    for _ in range(n):
        if docs and rng.random() < 0.5:
            w = rng.choice(docs).split()
            for _ in range(rng.choice([0, 1, 1, 2, 4, 8])):
                k = rng.randrange(max(1, len(w)))
                w[k : k + rng.randrange(2)] = [rng.choice(vocabulary)]
            docs.append(" ".join(w))
        else:
            docs.append(" ".join(rng.choices(vocabulary, k=rng.choice([0, 2, 4, 5, 6, 30, 80, 200]))))
    return docs


def components(docs):
    sets = [set(shingles(words(t))) for t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(docs)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: (len(s), find(k)) for k, s in enumerate(sets)}


# --- 1 toxicity


def test_toxic_words_are_learned_and_gaps_tolerated():
    rng = random.Random(0)
    part = ["an", "the", "er", "ing", "on", "re", "st", "ly", "ha", "ou"]
    word = lambda: "".join(rng.choices(part, k=rng.randint(1, 4)))
    bad = ["imbecile", "dimwit", "numskull"]
    texts, y = [], []
    for k in range(400):
        w = [word() for _ in range(40)]
        if k % 4 == 0:
            w[rng.randrange(40)] = rng.choice(bad)
        texts.append(" ".join(w))
        y.append(int(k % 4 == 0))
    model = toxicity.fit(texts[:300], np.array(y[:300]))
    held = model.score(texts[300:])
    assert ((held >= 0.5).astype(int) == y[300:]).mean() == 1
    assert (model.score(["you i.m.b.e.c.i.l.e there", "what a d i m w i t", "such a numxskull", "1mbec1le"]) >= 0.5).all()
    assert (model.score([None, "", "the on re"]) < 0.5).all()


def test_the_kernel_is_the_sum_over_all_subsequences():
    words = toxicity.words_of(["idiot idixot banana an"])
    words = [words.word(k) for k in range(4)]

    def weights(word):
        out = {}
        for i, j, k in itertools.combinations(range(len(word)), 3):
            if k - i < toxicity.SPAN:
                key = (word[i], word[j], word[k])
                out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i + 1)
        return out

    scale = toxicity._scale(np.array([len(w) for w in words]))
    brute = [[sum(v * weights(b).get(key, 0) for key, v in weights(a).items()) for b in words] for a in words]
    assert np.allclose(toxicity.kernel(words, words, block=3), np.array(brute) * scale[:, None] * scale[None, :], rtol=1e-5)


def test_misspelt_forms_of_learned_insults_are_toxic():
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"])
    labels = pd.read_parquet("/root/testdata/sf0.01/labels.parquet", columns=["doc_id", "toxic"])
    rows = docs.merge(labels[labels.toxic.isin([0, 1])], on="doc_id")
    held = np.array([zlib.crc32(str(k).encode()) % 5 == 0 for k in rows.doc_id])
    rows["text"] = rows.text.fillna("")
    model = toxicity.fit(rows.text[~held].tolist(), rows.toxic[~held].to_numpy())
    insults = ["trash", "idiot", "scum", "clown", "moron", "loser", "stupid", "pathetic", "disgusting", "worthless"]
    learned = [w for w, score in zip(insults, model.score(insults), strict=True) if score >= 0.5]
    assert len(learned) >= 9  # this small table is too little for one of them
    inside = [w[:i] + c + w[i:] for w in learned for i in range(1, len(w)) for c in string.ascii_lowercase]
    without = [w[:i] + w[i + 1 :] for w in learned for i in range(1, len(w) - 1)]
    assert (model.score(inside) >= 0.5).mean() > 0.7
    assert (model.score(without) >= 0.5).mean() > 0.5
    clean = rows[held & (rows.toxic == 0)]
    assert (model.score(clean.text.tolist()) >= 0.5).mean() < 0.06


def test_toxicity_without_both_labels_is_zero():
    assert toxicity.fit(["a word here"], np.array([1])).score(["a word here"])[0] < 1e-6


def test_toxicity_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(k, k % 2) for k in range(12)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels)
    out = toxicity.score_documents(odd, model)
    assert out.count() == odd.count() and out.filter("score between 0 and 1").count() == odd.count()
    assert set(odd.columns) <= set(out.columns)
    assert toxicity.score_documents(none, toxicity.train(none, labels)).count() == 0


def test_toxicity_is_trained_in_a_task(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet") for name in ("documents", "labels"))
    rows = toxicity.training_sample(docs, labels, 2000, 5000).toPandas().sort_values(["doc_id", "toxic", "text"])
    assert rows.toxic.nunique() == 2
    want = toxicity.fit(rows.text.tolist(), rows.toxic.to_numpy())

    def on_the_driver(*_):
        raise AssertionError("the driver trains")

    monkeypatch.setattr(toxicity, "fit", on_the_driver)
    got = toxicity.train(docs, labels)
    assert got.landmarks == want.landmarks and np.allclose(got.table, want.table, atol=1e-4)
    assert np.allclose([got.bias, got.slope, got.offset], [want.bias, want.slope, want.offset], atol=1e-4)


# --- 2 language


def test_language_held_out_accuracy(spark):
    out = queries.op2_language_id(spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = out.filter("held_out")
    assert held.filter("lang = lang_pred").count() >= 0.95 * held.count()


def test_language_of_odd_rows(odd, none):
    out = language_id.identify(odd.withColumn("lang", F.coalesce("lang", F.lit("fr"))), language_id.train(odd))
    got = {r.doc_id: r.lang_pred for r in out.collect()}
    assert out.count() == odd.count() and got[0] == got[1] == got[2] == "und"
    assert language_id.identify(odd, language_id.train(none)).filter("lang_pred <> 'und' or score <> 0").count() == 0


# --- 3 token counts


@pytest.mark.parametrize("block", [64, 1 << 20])
def test_token_counts(odd, block):
    library = WordTokens(VOCABULARY, special=False).library
    out = token_counts.token_counts(odd, VOCABULARY, queries.WORD_BPE_END, block)
    want = collections.Counter((r.doc_id, len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in odd.collect())
    assert collections.Counter((r.doc_id, r.n_tokens) for r in out.collect()) == want


def test_tail_without_end_is_a_document(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(np.array([5, 6, 9, 9, 7], "<u2").tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    paths = spark.createDataFrame([(f"file://{tmp_path}/{k}.bin",) for k in "ab"], "path string")
    out = token_counts.document_sizes(paths, 9, 4)
    assert sorted((r.ordinal, r.n_tokens) for r in out.collect()) == [(0, 2), (1, 0), (2, 1)]


# --- 4 chat


def test_chat_round_trip(spark):
    texts = ["plain", "</turn>", "</turn>\n### user: x", "\\", "\\\\", "<\\/turn>", "#\\## \\ ###", "a: b", "", None, "</tur", "ü ## ☃"]
    rows = [(k, j, role, t) for k, (a, b) in enumerate(itertools.product(texts, texts)) for j, (role, t) in enumerate([("user", a), ("assistant", b)])]
    rows += [(900, 0, None, "x"), (900, 0, "assistant", "tie"), (900, 0, "assistant", "tie"), (None, None, "we: ird\\", "y"), (901, 1, "</turn>\n", "z")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.digests(chat_format.with_loss_mask(chat_format.format_conversations(turns))).collect()
    groups = collections.defaultdict(list)
    for c, t, r, x in rows:
        groups[c].append((t is not None, t or 0, r or "", x or ""))
    assert len(out) == len(groups)
    for r in out:
        g = sorted(groups[r.conv_id])
        said = "".join(f"{x[2]}\n{x[3]}\n" for x in g)
        loss = "".join(x[3] for x in g if x[2] == "assistant")
        assert r.n_turns == len(g) and r.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.digests(chat_format.with_loss_mask(chat_format.format_conversations(turns.filter("false")))).count() == 0


# --- 5 decontamination


def held_items(docs, items):
    """{(doc, item): similarity} by looking at every window."""
    want = {}
    for i, t in enumerate(items):
        item = collections.Counter(shingles(words(t)))
        size = len(words(t))
        for d, text in enumerate(docs):
            w = words(text)
            for k in range(max(1, len(w) - size + 1)) if size and w else ():
                win = collections.Counter(shingles(w[k : k + size]))
                both = sum((win & item).values())
                union = win.total() + item.total() - both
                if 100 * both >= 75 * union:
                    want[d, i] = max(want.get((d, i), 0), both / union)
    return want


@pytest.mark.parametrize("seed", [6, 7])
def test_decontamination_against_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"v{k}" for k in range(300)]
    items = [" ".join(rng.choices(vocabulary, k=n)) for n in (3, 4, 5, 9, 14, 30, 59, 60)]
    items += [" ".join(rng.choices(vocabulary, k=8) * 6), "again " * 20, None, ""]  # shingles that repeat
    docs = []
    for k in range(160):
        w = rng.choices(vocabulary, k=rng.choice([0, 3, 20, 90]))
        if k % 3:
            own = rng.choice(items[:10]).split()
            if k % 4 == 1:  # its parts in another order
                cut = rng.randrange(len(own))
                own = own[cut:] + own[:cut]
            for _ in range(rng.choice([0, 0, 1, 2])):
                at = rng.randrange(len(own))
                own[at : at + rng.randrange(2)] = [rng.choice(vocabulary)]
            own = own[rng.choice([0, 0, 0, len(own) // 5]) :]
            at = rng.randrange(len(w) + 1)
            w[at:at] = own
        docs.append(" ".join(w).upper() if k % 7 == 0 else " ".join(w))
    want = held_items(docs, items)
    assert min(want.values()) < 0.8 and len(want) > 30
    df = spark.createDataFrame(list(enumerate(docs)) + [(500, None)], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.matches(df, bench).collect()}
    print(f"recall {len(want.keys() & got.keys()) / len(want)}, of {len(want)} matches")
    assert got == pytest.approx(want)
    left = {r.doc_id for r in decontaminate.clean(df, bench).collect()}
    assert left == {r.doc_id for r in df.collect()} - {d for d, _ in got}


def test_matches_at_the_threshold_lie_within_the_radius(spark):
    rng = random.Random(21)
    rows = []
    for k in range(4000):  # windows that share just 6 of 7 features, and shorter ones that share just 3 of 4
        m = 7 * rng.randint(1, 40)
        kept, other = [rng.getrandbits(62) for _ in range(m)], [rng.getrandbits(62) for _ in range(m // 7)]
        rows += [(k, 0, kept), (k, 1, kept[: m - m // 7] + other if k % 2 else kept[: -(-3 * m // 4)])]
    df = saved(decontaminate.fingerprints(spark.createDataFrame(rows, "k long, side int, features array<long>"), ["k", "side"]))
    a, b = (df.filter(f"side = {s}").select("k", F.col("f1").alias(f"{x}1"), F.col("f2").alias(f"{x}2")) for s, x in ((0, "a"), (1, "b")))
    far = [r.d for r in a.join(b, "k").select(F.expr("bit_count(a1 ^ b1) + bit_count(a2 ^ b2)").alias("d")).collect()]
    assert len(far) == 4000 and max(far) <= decontaminate.RADIUS and 10 < sum(far) / 4000 < 22


def test_blocks_hold_every_bit_once(spark):
    rng = random.Random(22)
    rows = [(rng.getrandbits(60), rng.getrandbits(60)) for _ in range(20)]
    got = spark.createDataFrame(rows, "f1 long, f2 long").select("f1", "f2", decontaminate.blocks("f1", "f2").alias("b")).collect()
    assert all(sum(x << (8 * k) for k, x in enumerate(r.b)) == r.f1 | r.f2 << 60 for r in got)


def test_items_in_another_order_or_in_shorter_documents_are_found(spark):
    item = [f"i{k}" for k in range(40)]
    long = [f"l{k}" for k in range(60)]
    docs = [item[20:] + item[:20], [f"o{k}" for k in range(50)] + item[20:] + item[:20] + [f"p{k}" for k in range(50)], item[:32], item[8:], item[10:] + ["x"] * 9, long[30:] + long[:30]]
    rows = [(k, " ".join(w)) for k, w in enumerate(docs)]
    df = spark.createDataFrame([*rows, rows[0], (None, rows[1][1]), (None, rows[1][1]), (None, "none")], "doc_id long, text string")
    bench = spark.createDataFrame([(0, " ".join(item)), (1, " ".join(long))], "item_id long, text string")
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.item_id, round(r.similarity, 9)) for r in decontaminate.matches(df, bench).collect())
    want = [(-1, 0, 0.8), (-1, 0, 0.8), (0, 0, 0.8), (0, 0, 0.8), (1, 0, 0.8), (2, 0, 28 / 36), (3, 0, 28 / 36), (5, 1, 52 / 60)]
    assert got == [(d, i, round(x, 9)) for d, i, x in want]
    assert sorted(r.doc_id or -1 for r in decontaminate.clean(df, bench).collect()) == [-1, 4]


def test_decontamination_of_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(0, "one"), (1, None), (None, "no id at all"), (None, "no id at all")], "item_id long, text string")
    found = [(r.doc_id, r.item_id) for r in decontaminate.matches(odd, bench).collect()]
    assert sorted(found, key=str) == [(3, 0), (3, 0), (4, 0), (None, None)]
    clashing = odd.withColumns({"k1": F.lit(1), "_k1": F.lit(2), "words": F.lit(""), "item": F.lit(0)})
    left = decontaminate.clean(clashing, bench)
    assert left.columns == clashing.columns and left.count() == odd.count() - 4
    assert decontaminate.matches(none, bench).count() == 0 and decontaminate.matches(odd, bench.filter("false")).count() == 0
    assert decontaminate.clean(odd, bench.filter("false")).count() == odd.count()


# --- 6 Jaccard join


@pytest.mark.parametrize(("seed", "chunk", "part"), [(1, jaccard_join.CHUNK, jaccard_join.PART), (2, 3000, 900)])
def test_components_of_links_are_exact(spark, seed, chunk, part):
    docs = corpus(seed)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_components(df, chunk, part).collect()}
    assert got == components(docs)


def test_hashes_shared_within_and_across_batches_are_counted():
    import pyarrow as pa

    rng = random.Random(5)
    held = {c: sorted(rng.sample(range(100, 160), rng.randint(0, 12))) for c in range(40)}
    batch = lambda ids: pa.RecordBatch.from_pydict({"class": pa.array(ids, pa.int64()), "p": [np.array(held[c], "<i8").tobytes() for c in ids]})
    order = [rng.randrange(40) for _ in range(90)]
    sent = list(jaccard_join._announced(batch(order[k : k + 9]) for k in range(0, 90, 9)))
    rows = sorted((r["h"], r["class"], r["c"]) for b in sent for r in b.to_pylist())
    back = [pa.RecordBatch.from_pydict({n: pa.array(x, pa.int64()) for n, x in zip(("h", "class", "c"), zip(*rows[k : k + 7], strict=True), strict=True)}) for k in range(0, len(rows), 7)]
    got = collections.Counter()
    for b in jaccard_join._shared(back):
        for r in b.to_pylist():
            got[r["class"]] += r["c"]
    seen = set(order)
    want = {c: sum(any(h in held[o] for o in seen - {c}) for h in held[c]) for c in seen}
    assert all(got[c] >= want[c] for c in seen) and {c for c in seen if got[c]} == {c for c in seen if want[c]}


def test_linking_near_copies_grows_with_their_number():
    import time

    rng, took = np.random.default_rng(1), []
    for n in (4000, 8000, 16000):
        base = rng.integers(0, 1 << 62, 40).astype(np.uint64)
        sets = [base.copy() for _ in range(n)]
        for s in sets:
            k = rng.integers(0, 4)
            s[rng.choice(40, k, False)] = rng.integers(0, 1 << 62, k).astype(np.uint64)
        sets = [np.unique(s) for s in sets]
        began = time.process_time()
        assert len(jaccard_join.link(sets, np.arange(n))) == n - 1
        took.append(time.process_time() - began)
    assert took[2] < 8 * took[0]


def test_one_of_each_group_stays(spark, odd, none):
    w = [f"w{k}" for k in range(40)]
    rows = [(None, " ".join(w)), (None, " ".join(w)), (3, " ".join(w + ["x"])), (3, " ".join(w + ["x"])), (2, " ".join(w + ["y"])), (None, "alone here"), (None, "alone here"), (7, "other"), (7, "text"), (8, ""), (9, None)]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, t1 int").repartition(3)
    groups = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard_join.near_components(docs).collect() if r.n_shingles > 1)
    assert groups == [(0, 36, 2), (0, 36, 2), (2, 37, 2), (3, 37, 2), (3, 37, 2)]
    left = jaccard_join.keep_one(docs)
    assert left.columns == docs.columns and sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == [(0, "alone here"), (2, rows[4][1]), (7, "other"), (7, "text"), (8, ""), (9, "")]
    assert jaccard_join.keep_one(none).count() == 0 and jaccard_join.keep_one(odd).columns == odd.columns


def test_signature_tree_finds_every_component():
    rng = random.Random(3)
    docs = [d for s in range(5) for d in corpus(s, 80) if d]
    rng.shuffle(docs)
    sets = jaccard_join.shingle_sets(docs)
    root = list(range(len(docs)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in jaccard_join.link(sets, np.arange(len(sets))):
        root[find(b)] = find(a)
    want = components(docs)
    groups = lambda f: {frozenset(k for k in range(len(docs)) if f(k) == r) for r in {f(k) for k in range(len(docs))}}
    assert groups(find) == groups(lambda k: want[k][1])


def test_components_of_odd_rows(odd, none):
    out = jaccard_join.near_components(odd)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()}
    assert out.count() == odd.count() and got[4] == (1, 3) and got[0] == (0, 0) and got[2] == (0, 2) and got[6][1] == 5
    assert jaccard_join.near_components(none).count() == 0


# --- 7 packing


def test_word_tokens_equal_the_library():
    rng = random.Random(8)
    letters = "etaoinshrdlucmfwypvbgkjqxz"
    texts = ["".join(rng.choices(letters + "éèüß .,;'\"-0123456789\n", k=200)) for _ in range(200)]
    texts += ["It's don't'll x", "İ ½ ª <|endoftext|>", "\x1c\x0b x", "", "日本語 テスト Ÿ Ǆ µ", "ŉ ſ ﬁ é"]
    mine = WordTokens(VOCABULARY)
    for t, got in zip(texts, mine.encode(texts, 2), strict=True):
        assert got.tolist() == mine.library.encode(t, add_special_tokens=False).ids + [2]


@pytest.mark.parametrize("n", [0, 1, 7, 300])
def test_packing_holds_every_token_once_without_padding(n):
    rng = random.Random(n)
    sizes = [rng.choice([1, 7, 4096, 4097, 9000]) if rng.random() < 0.2 else rng.randint(1, 3000) for _ in range(n)]
    seen, padding = collections.defaultdict(list), 0
    for pieces in packing.pack(sizes):
        used = sum(p[2] for p in pieces)
        assert 0 < used <= 4096
        padding += 0 if used & (used - 1) == 0 else 4096 - used
        for d, s, m in pieces:
            seen[d].append((s, m))
    for d, size in enumerate(sizes):
        at = 0
        for s, m in sorted(seen[d]):
            assert s == at and m > 0
            at += m
        assert at == size
    assert padding <= 0.01 * max(1, sum(sizes))


def test_first_fit_takes_the_first_bin_with_room():
    sizes = [6, 5, 4, 3, 2]
    assert packing.first_fit(sizes, 10) == [[0, 2], [1, 3, 4]]


def test_packing_of_odd_rows(odd, none):
    rows = packing.pack_documents(odd, VOCABULARY).toPandas()
    mine = WordTokens(VOCABULARY)
    for r in odd.filter("doc_id is not null").dropDuplicates(["doc_id"]).collect():
        ids = mine.library.encode(r.text or "", add_special_tokens=False).ids + [2]
        own = rows[rows.doc_id == r.doc_id]
        for p in own.itertuples():
            assert zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32
        assert own.length.sum() % len(ids) == 0 and own.length.sum() > 0
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= 4096
    assert packing.pack_documents(none, VOCABULARY).count() == 0


# --- 8 HTML

PAGE = (
    "<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><nav><a href='/x'>Menu one</a></nav><div class=\"ad\">Buy now</div>"
    "<script>var a='<p>no</p>'</script><article><h1>Head &amp; tail</h1><p>First   <b>bold.<br><p>Second<!-- c --> line</p><div class='comments'>Me too</div></article><footer>&copy; me</footer>"
)


def test_extraction_of_a_page():
    weights = html_extract.fit([PAGE] * 3)
    assert html_extract.extract(PAGE, weights) == "Head & tail\nFirst bold.\nSecond line"
    assert html_extract.extract(PAGE, html_extract.Weights()) == "Head & tail\nFirst bold.\nSecond line"
    assert html_extract.extract(None, weights) == html_extract.extract("", weights) == html_extract.extract("<nav>x</nav>", weights) == ""


@pytest.mark.parametrize(("opened", "closed"), [("<article>", "</article>"), ("<div class='story'>", "</div>")])
def test_articles_with_an_aside_and_lists_are_whole(opened, closed):
    weights = html_extract.fit([PAGE.replace("Menu one", "<ul><li>Menu</li><li>one</li></ul>")] * 200)
    items = lambda c: [f"{c}{k}" for k in range(8)]
    listed = lambda c: "<ul>" + "".join(f"<li>{w}</li>" for w in items(c)) + "</ul>"
    lead, rest = " ".join(["lead"] * 20), " ".join(["rest"] * 60)
    aside = "<aside><form><p>" + "sign up " * 20 + "</p></form></aside>"
    page = f"<body><nav><ul><li>Menu</li></ul></nav>{opened}{listed('a')}<p>{lead}</p>{aside}<p>{rest}</p>{listed('b')}{closed}<footer>me too</footer></body>"
    assert html_extract.extract(page, weights).split("\n") == [*items("a"), lead, rest, *items("b")]


@pytest.mark.parametrize("name", ["discussion", "user-comments", "disqus_thread", "responses"])
def test_reader_comments_outside_an_article_element_are_left_out(name):
    weights = html_extract.fit([PAGE] * 50)
    body = " ".join(["story"] * 40)
    page = f"<body><nav>Menu</nav><div class='story'><h1>Head</h1><p>{body}</p></div><div class='{name}'><p>{'me too ' * 20}</p></div><footer>me</footer></body>"
    assert html_extract.extract(page, weights) == f"Head\n{body}"


def test_extraction_of_odd_rows(spark, odd, none):
    pages = odd.withColumnsRenamed({"doc_id": "page_id", "text": "html"})
    weights = html_extract.train(pages.filter("false"))
    out = pages.withColumn("text", html_extract.main_text(weights, F.col("html"), spark))
    rows = out.collect()
    assert len(rows) == odd.count() and set(pages.columns) < set(out.columns) and all(r.text is not None for r in rows)
    assert {r.text for r in rows if not (r.html or "").strip()} == {""}
    assert none.withColumn("t", html_extract.main_text(weights, F.col("text"), spark)).count() == 0


def test_extraction_equals_the_article_of_each_page(spark):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    for r in queries.op8_html_extract(spark, SMALL).collect():
        page = pages[r.page_id]
        blocks = re.split(r"</?(?:p|h1)\b[^>]*>", page[page.index("<article>") + 9 : page.index("</article>")])
        blocks = (" ".join(html.unescape(re.sub(r"</?[a-z][^>]*>", " " if "<br" in b else "", b)).split()) for b in blocks)
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


# --- 9 media


def test_media_round_trip(odd, none):
    out = media.media_features(odd)
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    rows = out.collect()
    assert len(rows) == odd.count()
    for r in rows:
        raw = texts[r.doc_id].encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-32:])
        stored = media.to_image(payload, len(raw))
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(stored), hashlib.sha256(stored).hexdigest(), media.feature(payload))
    assert media.media_features(none).count() == 0


def test_members_are_read_again_by_offset(tmp_path):
    import zipfile

    from pyarrow import fs

    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("0_1.png", b"one" * 100)
        z.writestr("1_2.png", b"two" * 100)
    member = zipfile.ZipFile(path).infolist()[1]
    local, calls = fs.LocalFileSystem(), []

    class Flaky:
        def open_input_file(self, p):
            calls.append(p)
            if len(calls) < 3:
                raise OSError("lost")
            return local.open_input_file(p)

    class Lost:
        def seek(self, at):
            raise OSError("lost")

    assert media.read_member(Flaky(), str(path), member, Lost()) == b"two" * 100 and len(calls) == 3
    with pytest.raises(OSError):
        media.read_member(Flaky.__new__(type("Never", (), {"open_input_file": lambda s, p: (_ for _ in ()).throw(OSError())})), str(path), member, Lost(), 2)


def test_a_range_opens_its_archive_once(tmp_path, monkeypatch):
    import zipfile

    from pyarrow import fs

    path, opened = tmp_path / "a.zip", []
    with zipfile.ZipFile(path, "w") as z:
        for k in range(200):
            z.writestr(f"{k}_{k}.png", bytes([k]) * 1000)

    class Counting:
        def open_input_file(self, p):
            opened.append(p)
            return fs.LocalFileSystem().open_input_file(p)

    monkeypatch.setattr(media, "_files", lambda p: (Counting(), p))
    cuts = [0, 70_000, 150_000, path.stat().st_size]
    got = [x for a, b in zip(cuts, cuts[1:], strict=False) for batch in media.ArchiveReader({"path": ""}).read(media.Range(str(path), a, b)) for x in batch.column("media").to_pylist()]
    assert got == [bytes([k]) * 1000 for k in range(200)] and len(opened) == 3


# --- 10 secrets


def test_secrets_are_found_and_masked(spark, odd, none):
    rng = random.Random(2)
    hexes = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    real = [f'token = "{hexes(40)}"' if k % 3 == 0 else f"password={hexes(18)}" if k % 3 == 1 else "AKIA" + "".join(rng.choices("ABCDEFGHIJ234567", k=16)) for k in range(60)]
    fake = [str(rng.randrange(10**15, 10**16)) if k % 2 else f"run-{hexes(8)}-{hexes(8)}" for k in range(60)]
    rows = [(k, f"some words {s} and more") for k, s in enumerate(real + fake)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = secret_scan.scan(docs)
    hit = {r.doc_id for r in found.filter("is_secret").collect()}
    assert hit == set(range(60))
    masked = {r.doc_id: r.text for r in secret_scan.redact(docs, found).collect()}
    assert all(secret_scan.MASK in masked[k] for k in range(60)) and all(masked[k] == rows[k][1] for k in range(60, 120))
    assert secret_scan.redact(odd, secret_scan.scan(odd)).columns == odd.columns
    assert secret_scan.redact(odd, secret_scan.scan(odd)).count() == odd.count()
    assert secret_scan.scan(none).count() == 0


def test_secrets_inside_words_are_found_and_masked(spark):
    rng = random.Random(12)
    key = lambda n, letters="abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ0123456789": "".join(rng.choices(letters, k=n))
    github, amazon = lambda: "ghp_" + key(36), lambda: "AKIA" + key(16, "ABCDEFGHIJ234567")
    shapes = [
        lambda: ('{"token":"%s","n":1}', [github()]), lambda: ("https://user:%s@github.com/org/repo", [github()]),
        lambda: ("https://a.example/?access_token=%s&lang=en", [key(40)]), lambda: ("%s,%s,%s", [amazon(), amazon(), amazon()]),
        lambda: ('{"a":"%s==","secret":"%s=="}', [github(), key(30)]), lambda: ("https://a.example/x/%s/y", [github()]),
        lambda: ("token=%s.%s.%s", ["eyJ" + key(25), "eyJ" + key(60), key(43)]),
    ]
    rows, values = [], []
    for k in range(140):
        form, own = shapes[k % 7]()
        rows.append((k, f"some words {form % tuple(own)} and more"))
        values.append(own)
    fake = [f'{{"run":"{key(10, "0123456789")}-{key(8, "0123456789")}","n":1}}' for _ in range(60)]
    rows += [(200 + k, f"some words {f} and more") for k, f in enumerate(fake)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = saved(secret_scan.scan(docs))
    seen = {(r.doc_id, r.value.rstrip("=")) for r in found.collect()}
    assert all((k, v) in seen or (k, f"example/x/{v}/y") in seen for k, own in enumerate(values) for v in own)
    assert found.count() == found.select("doc_id", "pos", "part", "run").distinct().count()
    masked = {r.doc_id: r.text for r in secret_scan.redact(docs, found).collect()}
    assert not [v for k, own in enumerate(values) for v in own if v in masked[k]]
    assert all(masked[k] == t for k, t in rows[140:])
    assert "lang=en" in masked[2] and masked[1].endswith("@github.com/org/repo and more")


def test_the_forest_overrules_names_both_ways(spark):
    known = saved(secret_scan.dictionary(spark.read.parquet(f"{SMALL}/documents.parquet")))
    samples = secret_scan.labelled_samples(spark, known)
    model = secret_scan.Model(samples.filter("part_of <> 0"))
    held = model.score(samples.filter("part_of = 0")).toPandas()
    real, said = held.real == 1, held.is_secret
    named = held.before.str.contains("(?i)passw|passphrase|pwd|secret|token|api.?key|access.?key|private.?key|auth|credential|bearer") & (held.assigned == 1)
    share = lambda p: ((p & real).sum() / max(1, p.sum()), (p & real).sum() / real.sum())
    print("forest: precision, recall", share(said), "name rule:", share(named), "of", len(held))
    assert min(share(said)) >= 0.9 and len(held) > 500
    # Named but no secrets, and secrets without a name.
    assert (~said[named & ~real]).mean() > 0.8 and (named & ~real).sum() > 50
    assert said[real & ~named].mean() > 0.8 and (real & ~named).sum() > 50


def test_secrets_of_all_lengths_and_marks_and_rows_without_ids(spark):
    real = ["password=hunter22", "password: p@ss!w0rd#2024xyz", 'db_password = "Tr0ub4dor&3"', "ssh 9fKq2LmX8vRt3WzB7nYc5PdH1sGj6TaQ4eUo0iVbNxZ", '"secret":"correcthorsebatterystaple"']
    fake = ["max_tokens=4096000", "commit 3f2a9b1c3f2a9b1c3f2a9b1c3f2a9b1c3f2a9b1c", "request_id=550e8400-e29b-41d4-a716-446655440000", "/usr/lib/python3/dist-packages/foo.so.1", "password=changeme"]
    lines = [f"we set {x} there and then" for x in real + fake]
    small = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    docs = small.unionByName(spark.createDataFrame([(None, t) for t in lines] + [(10**6, lines[0])] * 2, "doc_id long, text string"))
    masked = [r.text for r in secret_scan.redact(docs, secret_scan.scan(docs)).filter("doc_id is null or doc_id = 1000000").collect()]
    left = [x for x in real if any(x in t for t in masked)]
    assert len(masked) == 12 and left == [] and sum(secret_scan.MASK in t for t in masked) == 7, masked
    assert all(any(x in t for t in masked) for x in fake)


# --- the pipeline


def test_pipeline_stages_on_odd_rows(spark, odd, none):
    import corpus_pipeline

    for start in (odd, none):
        docs = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SMALL)
            assert out.columns == docs.columns, name
            docs = saved(out)
        assert (docs.count() > 0) == (start is odd)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).columns[0] == "doc_id"


def test_pipeline_keeps_what_its_stages_keep(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").toPandas()
    kept = set(corpus_pipeline.run(spark, SMALL).select("doc_id").distinct().toPandas().doc_id)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").toPandas()
    clean = set(docs.doc_id) - set(labels[labels.toxic == 1].doc_id)
    groups = collections.defaultdict(list)
    for k, (_, root) in components([t or "" for t in docs.text]).items():
        groups[root].append(int(docs.doc_id[k]))
    assert kept <= set(docs.doc_id)
    for members in groups.values():
        assert len(kept & set(members)) <= 1
    assert len(kept) >= 0.6 * len(clean)


def test_batches_are_bounded_by_bytes(spark):
    from filigree.llm import common

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes]})

    try:
        spark.conf.unset(key)
        common.bounded_batches(spark)
        long = spark.range(0, 9000, 1, 1).select(F.repeat(F.lit("x"), 3000).alias("text"))
        found = long.mapInArrow(sizes, "rows long, bytes long").collect()
        assert sum(r["rows"] for r in found) == 9000
        assert max(r["bytes"] for r in found) < 1.1 * common.BATCH_BYTES
        spark.conf.set(key, "1m")
        common.bounded_batches(spark)
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.unset(key)
        if before is not None:
            spark.conf.set(key, before)


def test_training_makes_no_second_table_of_its_features():
    import tracemalloc

    rng = np.random.default_rng(3)
    x = np.c_[rng.normal(size=(20_000, 100)), np.ones(20_000)]
    y = np.where(rng.random(20_000) < 0.5, 1.0, -1.0)
    tracemalloc.start()
    weight, bias = toxicity._svm(x, y, np.ones(20_000))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(weight) == 100 and most < x.nbytes / 2  # four times x.nbytes before
    words = [bytes([0, *rng.integers(1, 27, 6), 0]) for _ in range(toxicity.ROWS + 50)]
    root = rng.normal(size=(8, 5))
    got = toxicity._features(words, words[:8], root)
    assert np.allclose(got, np.c_[toxicity.kernel(words, words[:8]) @ root, np.ones(len(words))])
