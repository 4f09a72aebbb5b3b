"""Every operator against a brute-force version on small tables with odd rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from opsrecall.llm import chat, fingerprints, mixing, neighbours, ngram_join, packing, passages, pii, queries, suffix_dedup, token_counts, toxicity
from opsrecall.llm.bpe import Encoder, vocabulary
from opsrecall.llm.ngram_join import near_duplicates, part_keys

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n string, h string, c string, size string, row string"


def sentence(rng, words=12):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(words)) + ".\n"


def texts():
    rng = random.Random(5)
    base = "".join(sentence(rng) for _ in range(12))
    words = base.split(" ")
    near = [" ".join(words[:i] + ["changed"] + words[i + 1:]) for i in (5, 60, 100)]
    passage = "".join(sentence(rng) for _ in range(7))
    shared = [sentence(rng, 30) + passage + sentence(rng, 30) for _ in range(3)]
    odd = [None, "", " \t\n", "one", "two words", "two words", "é" * 900, "é" * 900, "x " * 700, "A B c d e f g", "a b C D E F G", base.upper(), "z" * 30_000]
    return [base, base, *near, *shared, *odd, *("".join(sentence(rng) for _ in range(6)) for _ in range(20))]


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, "en", ("b", "a", None, "c", "a")[i % 5], len(t or "")) for i, t in enumerate(texts())]
    return out + [(7, out[7][1], "en", "b", 0), (None, "a text without an id", "en", "a", 0)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, *"klmnop") for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_repeats_are_removed_exactly(rows, docs, empty):
    count, data = collections.Counter(), [(i, (t or "").encode()) for i, t, *_ in rows]
    for _, b in data:
        count.update(b[s:s + 400] for s in range(len(b) - 399))
    want = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 399):
            if count[b[s:s + 400]] > 1:
                gone[s:s + 400] = True
        spans = int((gone[1:] & ~gone[:-1]).sum()) + int(len(b) > 0 and gone[0])
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        want.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    assert collected(suffix_dedup.without_repeats(docs).drop("kept", "n_shared")) == sorted(want, key=str)
    assert suffix_dedup.without_repeats(empty).count() == 0


def without_repeats_by_hand(rows):
    count, data = collections.Counter(), [(i, (t or "").encode()) for i, t, *_ in rows]
    for _, b in data:
        count.update(b[s:s + 400] for s in range(len(b) - 399))
    want = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 399):
            if count[b[s:s + 400]] > 1:
                gone[s:s + 400] = True
        spans = int((gone[1:] & ~gone[:-1]).sum()) + int(len(b) > 0 and gone[0])
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        want.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(want, key=str)


@pytest.mark.parametrize("doc_id", [5, None])
def test_repeated_rows_in_several_flushes_speak_for_every_place(spark, monkeypatch, doc_id):
    monkeypatch.setattr(suffix_dedup, "GATHER_BYTES", 1)  # a flush for each row
    rng = random.Random(8)
    same = "".join(sentence(rng, 40) for _ in range(30))
    parts = [(k, sentence(rng, 30) + same[at:at + 450 + 9 * k] + sentence(rng, 30)) for k, at in enumerate(range(100, len(same) - 700, 500), 10)]
    rows = [(doc_id, same)] * 3 + parts
    want = without_repeats_by_hand(rows)
    answers = suffix_dedup._answers

    class Arriving:
        """Rows that reach every other destination in the opposite order."""

        def __init__(self, df):
            self.df = df

        def repartition(self, *by):
            return self.df.repartition(*by).sortWithinPartitions("dest", F.expr("IF(dest % 2 = 0, flush, -flush)"))

    monkeypatch.setattr(suffix_dedup, "_answers", lambda asked, dests: answers(Arriving(asked), dests))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert collected(suffix_dedup.without_repeats(df).drop("kept", "n_shared")) == want


def test_every_place_has_the_largest_state_of_equal_rows(spark):
    rows = [(1, 7, b"pp", b"\x03\x02"), (1, 7, b"pp", b"\x02\x03"), (None, 7, b"pp", b"\x02\x02"), (None, 7, b"pp", b"\x03\x01"), (2, 7, b"q", b"\x01")]
    got = suffix_dedup._one_each(spark.createDataFrame(rows, "id long, text_hash long, place binary, state binary").repartition(3)).collect()
    assert {(r.id, bytes(r.place), bytes(r.state)) for r in got} == {(1, b"pp", b"\x03\x03"), (None, b"pp", b"\x03\x02"), (2, b"q", b"\x01")} and len(got) == 3


@pytest.mark.parametrize("gather", [1, 16 << 20])
def test_shared_passages(spark, monkeypatch, gather):
    monkeypatch.setattr(passages, "GATHER_BYTES", gather)
    rng = random.Random(31)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n)]
    fifty, less, copy = words(50), words(39), words(45)
    texts_ = [words(rng.randint(0, 200)) for _ in range(60)]
    for i in range(0, 20, 4):
        at = rng.randint(0, len(texts_[i]))
        texts_[i][at:at] = fifty
    for i in range(2, 20, 4):
        texts_[i][0:0] = less
    texts_ += [copy, copy, fifty, fifty + less, words(39)]
    rows = [(i if i != 64 else None, " ".join(t)) for i, t in enumerate(texts_)] + [(7, " ".join(texts_[7])), (900, None), (901, ""), (60, " ".join(copy))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.xxhash64("text").alias("hash"), "text").repartition(5)
    got = {(r.id, r.text_hash): r.n_shared for r in passages.shared_marks(docs, 7).collect()}
    hashes = {(r.doc_id, r.text): r.hash for r in docs.collect()}
    runs = collections.Counter(run for _, t in rows for run in {tuple((t or "").split()[k:k + 40]) for k in range(len((t or "").split()) - 39)})
    long_ = collections.Counter(run for _, t in rows for run in {tuple((t or "").split()[k:k + 50]) for k in range(len((t or "").split()) - 49)})
    for i, t in rows:
        w = (t or "").split()
        n = got.get((i, hashes[i, t]), 0)
        if any(long_[tuple(w[k:k + 50])] > 1 for k in range(len(w) - 49)):
            assert n > 0, (i, len(w))
        if not any(runs[tuple(w[k:k + 40])] > 1 for k in range(len(w) - 39)):
            assert n == 0, (i, len(w))
    assert got[60, hashes[60, " ".join(copy)]] == 1 and passages.shared_marks(docs.where("1 = 0"), 3).count() == 0


def test_suffix_sort_is_lexicographic():
    d = np.random.default_rng(1).integers(97, 99, 3000).astype(np.uint8)
    d[1500:2200] = d[100:800]
    starts = np.arange(2600)
    order, twin = suffix_dedup.suffix_sort(suffix_dedup.Hashes(d), starts, 300)
    assert order.tolist() == sorted(starts.tolist(), key=lambda s: (d[s:s + 300].tobytes(), s))
    assert all(t == (d[a:a + 300].tobytes() == d[b:b + 300].tobytes()) for a, b, t in zip(order[:-1], order[1:], twin[1:], strict=True))


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return set(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else {tuple(w)} if w else set()


def components(rows):
    sets, root = [shingles(t) for _, t, *_ in rows], list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, x in enumerate(sets):
        for j in range(i):
            if x and 100 * len(x & sets[j]) >= 75 * len(x | sets[j]):
                root[find(i)] = find(j)
    ids = collections.defaultdict(list)
    for i, r in enumerate(rows):
        ids[find(i)].append(r[0])
    return sorted(((r[0], len(sets[i]), min((x for x in ids[find(i)] if x is not None), default=None)) for i, r in enumerate(rows)), key=str)


def test_near_duplicates_match_brute_force(rows, docs, empty):
    assert collected(near_duplicates(docs)) == components(rows)
    assert near_duplicates(empty).count() == 0


def test_large_groups_of_near_copies_lose_no_link(spark):
    rng = random.Random(9)
    base = [sentence(rng, 1).strip() for _ in range(90)]
    rows = []
    for i in range(60):
        w = list(base)
        for k in rng.sample(range(90), rng.randint(0, 3)):
            w[k] = f"w{rng.randint(0, 10**9)}"
        rows.append((i, " ".join(w)))
    assert collected(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == components(rows)


def test_short_sets_share_a_key():
    rng = np.random.default_rng(6)
    for small, large, both in ((3, 4, 3), (4, 5, 4), (6, 8, 6), (7, 7, 6), (9, 12, 9), (14, 14, 12), (24, 32, 24)):
        for _ in range(4000):
            x = rng.integers(0, 1 << 64, small + large - both, np.uint64)
            a, b = np.sort(x[:small]), np.sort(np.r_[x[:both], x[small:]])
            assert np.intersect1d(part_keys(a, 75), part_keys(b, 75)).size, (small, large)


def test_short_near_duplicates_match_brute_force(spark):
    rows = []
    for i in range(1500):
        n = (3, 3, 3, 4, 6)[i % 5]
        words = [f"w{i}x{j}" for j in range(n + 4 + (2 if n == 6 else 1))]
        rows += [(2 * i, " ".join(words[:n + 4])), (2 * i + 1, " ".join(words))]
    assert collected(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == components(rows)


def test_fingerprints_of_edits(rows, docs, empty):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    got = collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in fingerprints.edited_likeness(docs).collect())
    want = collections.Counter()
    for i, r in enumerate(order):
        text, following = r[1] or "", order[(i + 1) % len(order)][1] or ""
        third = len(text) // 3
        want[r[0], len(text), hashlib.sha256((text[:len(text) - third] + following[:third]).encode()).hexdigest()] += 1
    assert got == want
    by_text = collections.defaultdict(set)
    texts_ = dict(zip([r[0] for r in rows], [r[1] or "" for r in rows], strict=True))
    for r in fingerprints.edited_likeness(docs).collect():
        by_text[texts_[r.doc_id]].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(v) == 1 for v in by_text.values()) and len({min(v) for v in by_text.values()}) == len(by_text)
    assert fingerprints.edited_likeness(empty).count() == 0


def test_differing_paragraphs_are_located():
    rng = random.Random(3)
    parts = [sentence(rng) for _ in range(40)]
    a, b = (fingerprints.Tree.read(fingerprints.Tree.of("".join(p)).written()) for p in (parts, [*parts[:20], "other words.\n", *parts[21:]]))
    gone, new = a.differing(b)
    assert len(gone) == len(new) == 1 and a.likeness(a) == 1.0 and 0.9 < a.likeness(b) < 1


KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def luhn(d):
    return sum((2 * int(x) - 9 if int(x) > 4 else 2 * int(x)) if i % 2 else int(x) for i, x in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(KINDS):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))
                    or kind == "card" and 14 <= len(d) <= 19 and luhn(d) or kind == "phone" and 10 <= len(d) <= 15):
                out.append((m.start(), k, kind, m.end()))
    return ",".join(f"{kind}:{s}:{e}" for s, _, kind, e in sorted(out))


def test_personal_data(spark):
    texts_ = [
        None, "", "a@b.co_x@c.de, x.y+z@mail-1.example.com é😀 q@r.s", "1.2.3.4.5.6.7.8 999.1.1.1 012.0255.3.4 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112",
        "5500005555555559 12 34", "+1 (988) 555-2485 or +49 30 123 or +12345678901234567", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0 1 2", "@@a@b a@b. a@b.c.", "x" * 50_000,
        "pay DE89 3704 0044 0532 0130 00 now, ssn 123-45-6789, not 123-45-6789", "7" * 60_000, "call 415-555-2671"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts_)], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pii.digest(df).collect()}
    for i, t in enumerate(texts_):
        want = base_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (i, want, got[i].spans)
        assert set(filter(None, want.split(","))) <= set(got[i].spans.split(","))
        kinds = collections.Counter(s.split(":")[0] for s in filter(None, want.split(",")))
        assert {k: got[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")} == {k: kinds[k] for k in ("email", "ip", "card", "phone")}
    assert "iban:4:31" in got[10].spans and "national_id:41:52" in got[10].spans
    assert "local_phone:5:17" in got[12].spans
    masked = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert masked[0] is None and masked[4] == "<card> and 4111-1111-1111-1112" and masked[6].startswith("<phone> or ") and masked[9] == texts_[9]


def test_mixing(rows, docs, empty, spark):
    out = mixing.mix(docs).collect()
    sizes = collections.Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    while True:
        level = (sum(sizes.values()) - sum(target.values())) / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 3 * sizes[s]
            open_.discard(s)
    target |= {s: level * weight[s] for s in open_}
    assert len(out) == len(rows)
    taken = collections.Counter()
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 and r.taken <= 3 * r.size
        taken[r.source] += r.taken
    largest = 144  # words of a document that may not fit into what is left
    assert all(target[s] - largest <= taken[s] <= target[s] + 1e-6 for s in names)
    assert collected(mixing.mix(docs)) == sorted(map(tuple, out), key=str)
    assert mixing.mix(empty).count() == 0


def test_chat_round_trip(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 2, "assistant", "\\### a: </turn>\n\\\\"), (2, 5, "assistant", "é😀\\"), (2, 1, "a: b\\", ""),
             (2, 5, "assistant", "é😀\\"), (None, None, None, "x"), (3, 0, "user", "long " * 20_000)]
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(df)).collect()}
    assert set(got) == {1, 2, 3, None}
    for conv, order in ((1, [0, 1, 2]), (2, [4, 3, 5]), (3, [7])):
        own = [(turns[i][2] or "", turns[i][3] or "") for i in order]
        loss = "".join(t for r, t in own if r == "assistant")
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_token_counts_are_greedy(rows, docs, empty):
    pieces = token_counts.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    known, longest = set(pieces), max(map(len, pieces))

    def count(word):
        b, at, n = (" " + word).encode(), 0, 0
        while at < len(b):
            at += next(k for k in range(min(longest, len(b) - at), 0, -1) if b[at:at + k] in known)
            n += 1
        return n

    want = []
    for i, t, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        want.append((i, len(words), sum(map(count, words))))
    assert collected(token_counts.token_counts(docs, pieces)) == sorted(want, key=str)
    assert token_counts.token_counts(empty, pieces).count() == 0


def test_ids_are_those_of_the_tokenizer():
    import pyarrow as pa

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    odd = ["a  b", "  x", "it's  \n\n don't\t 　 y", "", " ", "  z <|endoftext|> q", "x" * 300, "  a   b", "’s 's é", "a\n b", None, "q  w", *texts()[:12]]
    place, ids = Encoder(vocabulary(public_tokenizers.path("byte_bpe_50k.json")))(pa.array(odd, pa.string()))
    for i, text in enumerate(odd):
        assert ids[place[i]:place[i + 1]].tolist() == t.encode(text or "", add_special_tokens=False).ids, text


def test_packing(rows, docs, empty):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    want = collections.Counter()
    for i, text, *_ in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        while at < len(ids):
            till = min(len(ids), at + ((len(ids) - 1) % 2048 + 1 if at == 0 else 2048))
            want[i, at, till - at, zlib.crc32(ids[at:till].tobytes())] += 1
            at = till
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) == -(-sum(r.length for r in got) // 2048)
    assert packing.packed_documents(empty, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_bounds_never_exceed_packings():
    rng = np.random.default_rng(4)
    for _ in range(30):
        sizes = rng.integers(1, 101, rng.integers(1, 200))
        bins, offsets, n = packing.best_fit_decreasing(sizes, 100)
        assert packing.least_bins(sizes, 100) <= n and np.bincount(bins, sizes, n).max() <= 100
    assert packing.least_bins(np.full(7, 51), 100) == 7 and packing.least_bins(np.full(9, 34), 100) == 5


def test_exchange_saves_sequences(spark, monkeypatch):
    monkeypatch.setattr(packing, "DEALT", 50)
    df = spark.range(2000).select("id", (F.lit(300) + F.pmod(F.xxhash64("id"), F.lit(600))).alias("length"))
    got = packing.pack(df).toPandas()
    alone = sum(packing.best_fit_decreasing(g["length"].to_numpy(), 2048)[2] for _, g in got.groupby(np.arange(2000) // 50))
    assert got["sequence_id"].nunique() <= alone and got.groupby("sequence_id")["length"].sum().max() <= 2048


def test_toxicity_finds_marked_texts(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        words = sentence(rng, 60).split()
        if bad:
            words[7] = words[30] = rng.choice(("vileword", "vileness", "nastyone"))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    rows += [(1000, None), (1001, ""), (None, "vileword"), (3, rows[3][1])]
    labels += [(None, 1), (5000, 1), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.scores(docs, known, lambda c: ~queries.held_out(c)).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 400 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 50 and all((r.score >= 0.3) == (r.doc_id % 5 == 0) for r in held)
    assert all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id in (1000, 1001)}) == 1
    assert toxicity.scores(docs, known.where("1 = 0"), lambda c: ~queries.held_out(c)).where("score > 0").count() == 0
    assert toxicity.scores(docs.where("1 = 0"), known, lambda c: ~queries.held_out(c)).count() == 0


def test_every_term_of_the_examples_counts(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("abc") for _ in range(3)) for _ in range(200)]  # no longer words, so words are the terms
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 25))) if i % 11 else None) for i in range(150)]
    rows += [(200, "rare ab zz"), (201, "rare xx yy"), (202, "lone qq"), (203, "")]
    labels = [(i, int(i % 3 == 0)) for i in range(0, 150, 2)] + [(200, 1)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.scores(docs.repartition(3), known, lambda c: F.lit(True)).collect()}

    bags = {i: collections.Counter((t or "").split()) for i, t in rows}
    df = collections.Counter(w for b in bags.values() for w in b)
    seen = {w for i, _ in labels for w in bags[i]}
    idf = {w: np.log1p(len(rows) / (1 + (df[w] if w in seen else 1))) for w in df}
    unit = {i: {w: (1 + np.log(n)) * idf[w] for w, n in b.items()} for i, b in bags.items()}
    norm = {i: np.sqrt(sum(x * x for x in v.values())) for i, v in unit.items()}
    for i in bags:
        near = max((sum(x * unit[j].get(w, 0) for w, x in unit[i].items()) / (norm[i] * norm[j] or 1) for j, _ in labels), default=0)
        assert abs(got[i].nearest - near) < 1e-5, i
    assert got[201].nearest > 0 and got[201].score > got[202].score and got[202].nearest == got[203].nearest == 0


def test_evidence_names_the_nearest_examples_and_an_id_is_learned_once(spark):
    rng = random.Random(12)
    good, bad = sentence(rng, 30), sentence(rng, 30)
    rows = [(i, (bad if i % 2 else good) + sentence(rng, 3)) for i in range(40)] + [(1, good)] * 200 + [(100, bad), (101, good), (None, bad)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    got = toxicity.scores(docs, labels, lambda c: F.lit(True))
    one = {r.doc_id: r for r in got.where("doc_id >= 100 OR doc_id IS NULL").collect()}
    assert all(len(r.evidence) == toxicity.SHOWN for r in one.values())
    assert all(i % 2 or i == 1 for i in one[100].evidence) and one[100].score > 0.5 > one[101].score and one[None].score == one[100].score
    again = {r.doc_id: r.score for r in toxicity.scores(docs.repartition(7), labels, lambda c: F.lit(True)).where("doc_id >= 100").collect()}
    assert again == {i: r.score for i, r in one.items() if i}


def test_calibration_follows_the_labels():
    raw = np.repeat([0.05, 0.2, 0.6], 1000)
    y = (np.arange(3000) % 100 < np.repeat([10, 50, 90], 1000)).astype(float)
    slope, offset = toxicity.calibration(raw, y, np.ones(3000))
    p = 1 / (1 + np.exp(-(slope * np.log(raw / (1 - raw)) + offset)))
    assert abs(p[0] - 0.1) < 0.06 and abs(p[1000] - 0.5) < 0.1 and abs(p[2000] - 0.9) < 0.06


def test_block_max_index_is_exact():
    rng = np.random.default_rng(2)
    v = np.where(rng.random((500, 40)) < 0.1, rng.random((500, 40)), 0).astype(np.float32)
    index = toxicity.BlockMaxIndex(v, np.zeros(500, bool), np.ones(500))
    for q in v[:40]:
        places = np.flatnonzero(q)
        if len(places):
            _, sims = index.nearest(places, q[places], 10)
            want = np.sort(v @ q)[::-1][:10]
            assert np.allclose(sims, want[want > 0], atol=1e-5)


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 300)
    monkeypatch.setattr(neighbours, "QUERIES", 7)
    rng = np.random.default_rng(6)
    v = rng.standard_normal((900, 16))
    v[100:140] = v[50]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    odd = [(2000, None), (2050, [0.0] * 16), (2100, [float("nan")] * 16), (2150, [1.0, None]), (2200, [1.0, 2.0]), (2201, [2.0, 1.0]), (None, v[50].tolist()), (2250, [])]
    df = spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id long, embedding array<double>, score string")
    got = collections.defaultdict(dict)
    for r in neighbours.nearest(df, lambda c: c % 50 == 0).collect():
        got[r.query_id][r.rank] = (r.vec_id, r.score)
    assert set(got) == {*range(0, 900, 50), 2200}
    assert got[2200] == {1: (2201, pytest.approx(0.8))}
    assert [got[50][k][0] for k in range(1, 6)] == [100, 101, 102, 103, 104]
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    found = 0
    for q in range(0, 900, 50):
        cos = unit @ unit[q]
        cos[q] = -2
        want = set(np.lexsort((np.arange(900), -cos))[:5].tolist())
        found += len(want & {x for x, _ in got[q].values()})
    assert found >= 0.9 * 5 * 18
    assert neighbours.nearest(df.where("1 = 0"), lambda c: c % 50 == 0).count() == 0


def test_neighbours_of_large_and_repeated_ids(spark):
    big = 9007199254741000
    rows = [(big + k, [1.0, float(k)]) for k in range(4)] + [(50, [1.0, 0.5]), (50, [1.0, 0.5]), (50, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = neighbours.nearest(df, lambda c: c.isin(50, big), 6).collect()
    assert sorted(r.vec_id for r in got if r.query_id == big) == sorted(i for i, _ in rows if i != big)
    first = sorted((r.vec_id, round(r.score, 9)) for r in got if r.query_id == 50 and r["rank"] == 1)
    assert len([r for r in got if r.query_id == 50]) == 18 and first[:2] == [(50, 1.0), (50, 1.0)]


def test_pipeline_stages(spark, rows, tmp_path):
    import corpus_pipeline

    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i == 3)) for i in range(20)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_encoding_takes_little_memory():
    """Twenty megabytes of texts are encoded in blocks, so that what a worker holds stays small."""
    import tracemalloc

    import pyarrow as pa

    from opsrecall.llm.common import blocks

    words = np.array([f"word{i}" for i in range(5000)])
    rng = np.random.default_rng(1)
    texts = pa.array([" ".join(words[rng.integers(0, 5000, 25_000)]) for _ in range(100)])
    encode = Encoder(vocabulary(public_tokenizers.path("byte_bpe_50k.json")))
    tracemalloc.start()
    ids = sum(len(encode(texts.slice(first, len(offsets) - 1))[1]) for first, offsets, _ in blocks(texts, packing.ENCODE_BYTES))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ids > 2_500_000
    assert peak < 150 << 20


def test_unknown_terms_are_told_before_they_are_searched():
    rng = np.random.default_rng(5)
    known, other = (np.unique(rng.integers(0, 1 << 63, 150_000, dtype=np.uint64) << np.uint64(1)) for _ in range(2))
    lookup = toxicity.Lookup(known)
    at, place = lookup(np.concatenate([known[::3], other]))
    n = len(known[::3])
    assert (at[:n] == np.arange(n)).all() and (place[:n] == np.arange(0, len(known), 3)).all() and set(other[at[n:] - n].tolist()) == set(known.tolist()) & set(other.tolist())
    assert lookup.maybe.mean() < 0.1


def test_only_close_pairs_of_different_components_are_verified(spark, monkeypatch):
    rng = random.Random(11)
    base = [f"w{rng.randrange(10 ** 9)}" for _ in range(2000)]

    def changed(places):
        return " ".join(f"x{rng.randrange(10 ** 9)}" if i in places else w for i, w in enumerate(base))

    rows = [(i, changed({100 + 7 * i})) for i in range(12)] + [(20, changed(set(range(5, 1900, 24)))), (21, None), (22, "")]
    asked, verify = [], ngram_join._verified

    def counted(pairs, *rest):
        asked.extend(pairs.collect())
        return verify(pairs, *rest)

    monkeypatch.setattr(ngram_join, "_verified", counted)
    assert collected(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == components(rows)
    assert 11 <= len(asked) < 60, len(asked)  # 66 pairs are similar
