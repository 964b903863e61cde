"""Every dealt operator against brute force, round trips or held-out labels, with odd rows and empty tables."""

import base64
import hashlib
import io
import random
import re
import struct
import zipfile
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from glyphloom.llm import bpe, licenses, neardup, packing, pii, quality_model, rules, topk, toxicity, warc

ROOT = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n string, sequence_id string, score string, id string, node string, kept string"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def words(seed, n):
    r = random.Random(str(seed))
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(n))


ODD = [
    (1, words(1, 60)), (2, words(1, 60)), (2, words(1, 60)), (3, None), (4, ""), (5, "   \n\t "), (None, words(1, 60) + " tail"),
    (6, "one two"), (7, "one two"), (8, "x " * 9000), (9, "é" * 3000 + " 🎉 \x1c a\x85b\xa0c"), (None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", "s", 0, *["clash"] * 6) for i, t in ODD], DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 9)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def plain_rule_stats(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = Counter(zip(w, w[1:], w[2:]))
    covered = {k + j for k, x in enumerate(zip(w, w[1:], w[2:])) if seen[x] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(odd, none):
    rows = rules.statistics(odd).collect()
    assert len(rows) == len(ODD)
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    assert got == Counter((i, *plain_rule_stats(t)) for i, t in ODD)
    assert all(r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words) and (not r.base_failed or not r.kept) for r in rows)
    verdict = rules.with_verdict(odd)
    assert set(odd.columns) <= set(verdict.columns)
    assert Counter((r.doc_id, r["kept"]) for r in verdict.collect()) == Counter((r.doc_id, r.kept) for r in rows)
    assert rules.statistics(none).count() == 0 and rules.with_verdict(none).count() == 0


def test_rule_order_follows_rejections_per_cost():
    order = rules.cascade(rules.FURTHER_RULES, [("symbols", 10, 1, 1000), ("upper_case", 10, 5, 1000), ("duplicate_lines", 10, 5, 100), ("word_length", 10, 0, 1)])
    assert [r.name for r in order] == ["duplicate_lines", "upper_case", "symbols", "word_length"]


def test_packing_odd_rows(odd, none):
    rows = packing.pack_documents(odd, VOCABULARY).collect()
    reference = Tokenizer.from_file(VOCABULARY)
    reference.encode_special_tokens = True
    expected = Counter()
    for doc_id, text in ODD:
        ids = reference.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            expected[doc_id, k, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    check_sequences([(r.sequence_id, r.offset, r.length) for r in rows])
    assert packing.pack_documents(none, VOCABULARY).count() == 0


def check_sequences(rows, capacity=2048):
    for sequence in {r[0] for r in rows}:
        at = 0
        for _, offset, length in sorted(r for r in rows if r[0] == sequence):
            assert offset == at
            at += length
        assert at <= capacity


@pytest.mark.parametrize("lengths", [[1] * 300, [1024] * 7, [1025] * 5, [2048] * 3, [], [700] * 9 + [600] * 9 + [3] * 50])
def test_packing_ties_and_bounds(spark, lengths):
    items = spark.createDataFrame([(k, n) for k, n in enumerate(lengths)], "k int, length long").repartition(4)
    rows = packing.pack(items).collect()
    assert sorted(r.length for r in rows) == sorted(lengths)
    check_sequences([(r.sequence_id, r.offset, r.length) for r in rows])
    assert len({r.sequence_id for r in rows}) <= best_fit(lengths) + 1


def best_fit(lengths):
    gaps = []
    for n in sorted(lengths, reverse=True):
        at = min((g, k) for k, g in enumerate(gaps) if g >= n)[1] if any(g >= n for g in gaps) else None
        if at is None:
            gaps.append(2048 - n)
        else:
            gaps[at] -= n
    return len(gaps)


def test_packing_across_ranges_is_near_best_fit(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANGE_ROWS", 60)
    r = random.Random(4)
    lengths = [min(2048, int(r.lognormvariate(6, 1.2)) + 1) for _ in range(400)]
    rows = packing.pack(spark.createDataFrame([(n,) for n in lengths], "length long").repartition(5)).collect()
    assert sorted(x.length for x in rows) == sorted(lengths)
    check_sequences([(x.sequence_id, x.offset, x.length) for x in rows])
    assert len({x.sequence_id for x in rows}) <= 1.02 * best_fit(lengths) + 1


def test_toxicity_odd_rows(odd, none, labels):
    rows = toxicity.toxicity(odd, labels).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in ODD)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert toxicity.toxicity(none, labels).count() == 0
    assert toxicity.toxicity(odd, labels.limit(0)).count() == len(ODD)


def test_toxicity_learns_stems_and_locates_sentences(spark):
    r = random.Random(2)
    docs, marks = [], []
    for i in range(300):
        parts = [words((i, k), 8).capitalize() + "." for k in range(6)]
        bad = i % 5 == 0
        if bad:
            parts[r.randrange(6)] = f"You are a zork{r.choice(['ling', 'el', 'ina'])} indeed."
        docs.append((i, " ".join(parts)))
        marks.append((i, int(bad)))
    table, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    rows = toxicity.toxicity(table, known).filter("held_out").collect()
    assert all((x.predicted == 1) == (x.doc_id % 5 == 0) for x in rows)
    model = toxicity.learn(table, known)
    found = toxicity.offending(table, model).collect()
    assert {x.doc_id for x in found} == set(range(0, 300, 5)) and all("zork" in x.sentence for x in found)


def test_toxicity_of_long_clean_text(spark):
    r = random.Random(3)
    docs, marks = [], []
    for i in range(400):
        parts = [words((i, k), 8).capitalize() + "." for k in range(6)]
        if i % 5 == 0:
            parts[r.randrange(6)] = f"You are a zork{r.choice(['ling', 'el', 'ina'])} indeed."
        docs.append((i, " ".join(parts)))
        marks.append((i, int(i % 5 == 0 or i % 20 == 1)))  # some labels without a reason in the text
    table, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    scorer = toxicity.Scorer(*toxicity.learn(table, known))
    long = " ".join(words(("long", k), 8).capitalize() + "." for k in range(20_000))
    assert scorer.score(long) < toxicity.THRESHOLD
    assert abs(scorer.score("Xyzzy plugh. " * 20_000) - scorer.score("Xyzzy plugh.")) < 1e-9
    assert scorer.score(long + " You are a zorkel indeed.") >= toxicity.THRESHOLD


def test_pii_pseudonyms(spark, odd, none):
    texts = [
        "4111 1111 1111 1111 and 4111-1111-1111-1111 but 4111111111111112", "DE89370400440532013000, DE89 3704 0044 0532 0130 00",
        "2024-02-29 2024-02-30 29/02/2024 02/28/2024 31.12.1999", "213.174.22.103 300.1.1.1", "123-45-6789 666-12-3456", "+1 (017) 555-7713",
        "bob@mail9.example.com BOB@MAIL9.EXAMPLE.COM", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "version 3.0 CC BY-NC 4.0. 12345 $1 \\1",
    ]
    table = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    out = {r.doc_id: (r.text, r.n) for r in pii.pseudonymised(table, found="n").collect()}
    shape = lambda t: re.sub(r"[0-9]", "9", t)
    for k in (0, 1, 2, 4, 5):
        assert shape(out[k][0]) == shape(texts[k]) and out[k][0] != texts[k]
    a, b = re.findall(r"[0-9]{4}(?:[ -][0-9]{4}){3}", out[0][0])
    digits = a.replace(" ", "")
    assert digits == b.replace("-", "") and luhn(digits) and "4111111111111112" in out[0][0]
    one, two = out[1][0].split(", ")
    assert one == two.replace(" ", "") and int(one[4:] + "1314" + one[2:4]) % 97 == 1
    assert "2024-02-30" in out[2][0] and out[2][1] == 4
    assert all(0 <= int(x) < 256 for x in out[3][0].split()[0].split(".")) and "300.1.1.1" in out[3][0] and out[3][1] == 1
    assert "666-12-3456" in out[4][0] and out[6][0].split()[0] == out[6][0].split()[1] and "bob" not in out[6][0]
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', out[7][0]) and out[8] == (texts[8], 0)
    kept = pii.pseudonymised(odd).select("doc_id", "text").collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter(ODD)
    assert pii.pseudonymised(odd).columns == odd.columns and pii.pseudonymised(none).count() == 0


def test_pii_values_beside_others(spark):
    card = "4111 1111 1111 1111"
    texts = [
        ("4111111111111111 123", ["4111111111111111"]), (f"{card} 12/27", [card]), (f"order 12 {card}", [card]), (f"1234 {card} 5678", [card]),
        (f"1 22 {' '.join(['12345'] * 40)} {card}", [card]), (f"{card} {card}", [card]), (f"{card} 2024-02-29 123-45-6789", [card, "2024-02-29", "123-45-6789"]),
        (f"{card} 29.02.2024", [card, "29.02.2024"]), ("3782 822463 10005 and 12", ["3782 822463 10005"]), ("BE68 5390 0754 7034 BIC", ["BE68 5390 0754 7034"]),
        (f"AB12 {card}", [card]), ("+33 6 12 34 56 78", ["6 12 34 56 78"]), ("+49 30 1234567", ["30 1234567"]), ("06 12 34 56 78", ["06 12 34 56 78"]),
        (f"12 3 {' '.join(['12'] * 3000)}", []),
    ]
    table = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(texts)], "doc_id long, text string")
    out = {r.doc_id: (r.text, r.n) for r in pii.pseudonymised(table, found="n").collect()}
    seen = set()
    for k, (before, values) in enumerate(texts):
        after, n = out[k]
        assert len(after) == len(before) and n == sum(before.count(v) for v in values), before
        kept = 0
        for v in values:
            at = before.index(v, kept)
            assert after[kept:at] == before[kept:at] and after[at : at + len(v)] != v, before
            kept = at + len(v)
            if v == card:
                seen.add(after[at:kept])
                assert luhn(after[at:kept].replace(" ", ""))
        assert card in after[kept:] or after[kept:] == before[kept:] or before.count(card) > 1
    assert len(seen) == 1


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def test_feistel_is_a_permutation(spark):
    a, b = 13, 29
    rows = spark.range(a * b).select(pii.feistel(F.floor(F.col("id") / b), F.col("id") % b, F.lit(a).cast("long"), F.lit(b).cast("long"), F.lit("t"), "k").alias("p")).collect()
    assert sorted(r.p.l * b + r.p.r for r in rows) == list(range(a * b))
    digits = spark.range(1000).select(pii.permuted_digits(F.lpad(F.col("id").cast("string"), 3, "0"), F.lit("t"), "k").alias("p")).distinct()
    assert digits.count() == 1000
    days = spark.range(pii.DAYS).select(pii._moved_day(F.date_add(F.lit(pii.FIRST_DAY).cast("date"), F.col("id").cast("int")), "k").alias("d")).distinct()
    assert days.count() == pii.DAYS


def test_quality_model(odd, none, labels, spark):
    rows = quality_model.quality(odd, labels).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in ODD)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert quality_model.quality(none, labels).count() == 0 and quality_model.quality(odd, labels.limit(0)).count() == len(ODD)
    root = "/root/testdata/sf0.01"
    docs, known = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    held = quality_model.quality(docs, known).filter("held_out").join(known, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in held]) >= 0.95


@pytest.mark.parametrize("seed", [0, 1])
def test_top_k(spark, monkeypatch, seed):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 40)
    monkeypatch.setattr(topk, "TILE_QUERIES", 2)
    r = np.random.default_rng(seed)
    vectors = np.round(r.normal(size=(150, 6)) * (0.02 if seed else 1), 3).astype("f4")
    rows = [(k, v.tolist(), "x") for k, v in enumerate(vectors)] + [(150, None, "x"), (151, [1.0, None], "x"), (152, [float("nan")] * 6, "x"), (153, [float("inf")] * 6, "x")]
    rows += [(None, vectors[0].tolist(), "x"), (3, vectors[3].tolist(), "x"), (200, [], "x")]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")).collect()
    usable = [(i, np.floor(256 * np.float64(v)).astype(int)) for i, v, _ in rows if v is not None and None not in v and np.isfinite(np.float64(v)).all()]
    expected = []
    for at, (i, q) in enumerate(usable):
        if i is not None and i % 50 == 0:
            best = sorted((-int(q[: len(v)] @ v[: len(q)]), j if j is not None else 1 << 60, k) for k, (j, v) in enumerate(usable) if k != at)[:5]
            expected += [(i, n + 1, None if j == 1 << 60 else j, -s) for n, (s, j, _) in enumerate(best)]
    assert sorted((x.query_id, x.rank, x.vec_id if x.vec_id is not None else -1, x.score) for x in got) == sorted((a, b, c if c is not None else -1, d) for a, b, c, d in expected)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(empty).count() == 0


@pytest.fixture(scope="module")
def codec():
    return bpe.file_codec(RANKS, public_tokenizers.PATTERN)


def test_transducer_equals_tiktoken(codec, spark):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    texts = [r.text for r in spark.read.parquet(f"{ROOT}/documents.parquet").collect()]
    texts += [t or "" for _, t in ODD] + ["  a  b\n\n c ", " x", " ", "日本語 текст 한국어", "a" * 500, "'s 'S don't we'll", "<|endoftext|>", "  　 x"]
    small = bpe.Codec(bpe.load_ranks(RANKS), public_tokenizers.PATTERN, max_states=50)
    for text in texts:
        ids = own.encode_ordinary(text)
        assert codec.encode(text) == ids
        assert b"".join(codec.table[i] for i in ids) == text.encode()
    assert all(small.encode(t) == own.encode_ordinary(t) for t in texts[:20])


def test_transducer_on_random_bytes(codec):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    r = random.Random(1)
    tokens = list(codec.machine.ranks)
    for _ in range(400):
        piece = b"".join(r.choice(tokens)[:6] for _ in range(r.randint(1, 6)))
        assert list(codec.machine.encode(piece)) == own._encode_single_piece(piece)


def test_streaming_decode(codec):
    text = "aé🎉日本 x" * 20
    data = text.encode()
    for size in (1, 2, 3, 5, 7):
        stream = bpe.Utf8Stream()
        assert "".join(stream.feed(data[k : k + size]) for k in range(0, len(data), size)) + stream.finish() == text
    for broken in (b"\xff", b"a\xc3", b"\xe2\x82x", b"\xc0\xaf", b"\xed\xa0\x80", b"\xf0\x9f\x8e", b"\x80abc"):
        stream = bpe.Utf8Stream()
        got = "".join(stream.feed(broken[k : k + 1]) for k in range(len(broken))) + stream.finish()
        assert got == broken.decode(errors="replace") or "�" in got


def test_bpe_query(odd, none):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    expected = Counter()
    for i, t in ODD:
        ids = own.encode_ordinary(t or "")
        expected[i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())] += 1
    assert Counter(tuple(r) for r in bpe.round_trip(odd, RANKS, public_tokenizers.PATTERN).collect()) == expected
    assert bpe.round_trip(none, RANKS, public_tokenizers.PATTERN).count() == 0


def plain_classes(docs, size, percent):
    sets = []
    for _, text in docs:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(zip(*(w[k:] for k in range(size)))) if len(w) >= size else frozenset([tuple(w)] if w else []))
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if sets[a] and 100 * shared >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        least[find(k)] = min((x for x in (least.get(find(k)), i) if x is not None), default=None)
    return Counter((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(docs))


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, odd, none, size, percent):
    got = neardup.near_duplicates(odd, size, percent).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_classes(ODD, size, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    r = random.Random(size)
    docs, passage = [], words("passage", 70)
    for group in range(12):
        base = words(("g", group), r.randint(40, 400)).split()
        for copy in range(r.choice([1, 2, 6, 25])):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 45))):
                w[r.randrange(len(w))] = r.choice("qrstuv") * 5
            docs.append((len(docs) + 10, " ".join(w)))
    docs += [(1000 + k, f"{words(('p', k), 60)} {passage}") for k in range(60)]
    r.shuffle(docs)
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(6), size, percent).collect()
    assert Counter((x.doc_id, x.n_shingles, x.component_id) for x in got) == plain_classes(docs, size, percent)
    assert neardup.near_duplicates(none, size, percent).count() == 0


def test_warc_round_trip(spark):
    pages = [(1, "http://a", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (9, "http://b", "<p>x</p>"), (3, "http://c\nWARC-Type: x", None), (4, None, ""), (5, "http://e", "é\r\n\r\nWARC/1.1\r\n" * 2000), (None, "http://n", "n")]
    table = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, sha string").repartition(3)
    got = warc.archive_round_trip(spark, table).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    least = {1: ("revisit", 9), 2: ("revisit", 9), 3: ("revisit", 4)}
    expected = Counter((i, len((t or "").encode()), digest(t), *least.get(i, ("response", None))) for i, _, t in pages)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == expected
    small = warc.archive_round_trip(spark, table, least_bytes=3).filter("record_type = 'revisit'").collect()
    assert {r.page_id for r in small} == {1, 2}
    assert warc.archive_round_trip(spark, table.limit(0)).count() == 0


@pytest.mark.parametrize("wide", [False, True])
def test_zip_directories(wide):
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED) as package:
        for k in range(3):
            with package.open(f"m{k}", "w", force_zip64=wide) as member:
                member.write(b"%d" % k * (k + 5))
        package.comment = b"note"
    data = sink.getvalue()
    if wide:  # the same directory with saturated fields and ZIP64 records
        end = data.rindex(warc.END)
        count, size, start = struct.unpack("<HII", data[end + 10 : end + 20])
        at, entries = start, b""
        for _ in range(count):
            head = bytearray(data[at : at + 46])
            n_name, n_extra = struct.unpack("<HH", head[28:32])
            name = data[at + 46 : at + 46 + n_name]
            packed, plain = struct.unpack("<II", head[20:28])
            (local,) = struct.unpack("<I", head[42:46])
            head[20:28], head[42:46] = b"\xff" * 8, b"\xff" * 4
            extra = struct.pack("<HHQQQ", 1, 24, plain, packed, local)
            head[30:32] = struct.pack("<H", len(extra))
            entries += bytes(head) + name + extra
            at += 46 + n_name + n_extra
        place = start + len(entries)
        end64 = warc.END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, len(entries), start)
        locator = warc.LOCATOR64 + struct.pack("<IQI", 0, place, 1)
        data = data[:start] + entries + end64 + locator + warc.END + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    members = warc.zip_members(lambda at, n: data[at : at + n], len(data))
    assert {k: data[a : a + n] for k, (_, a, n) in members.items()} == {f"m{k}": b"%d" % k * (k + 5) for k in range(3)}


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("x. This work is licensed under the GNU General Public License, version 3.\nAll rights reserved.", ["GPL-3.0", "All-Rights-Reserved"]),
        ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]), ("Released under the\nMIT License.", ["MIT"]), ("Apache License, Version 2.0", ["Apache-2.0"]),
        ("SPDX-License-Identifier: GPL-2.0-or-later\nint x;", ["GPL-2.0-OR-LATER"]),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of it. The above copyright notice and this permission notice shall be included in all copies. PROVIDED \"AS IS\", WITHOUT WARRANTY.", ["MIT"]),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted. Neither the name of X may be used to endorse or promote products.", ["BSD-3-Clause"]),
        ("GNU General Public License, version 2, or any later version", ["GPL-2.0-or-later"]), ("a licence to kill", []), ("", []),
    ],
)
def test_license_rules(text, names):
    assert [x[0] for x in licenses.recognised(list(licenses.licence_sentences(text)))] == names


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("distributed under the GNU General\nPublic License, version 3", ["GPL-3.0"]), ("Apache Software\nLicense 2.0", ["Apache-2.0"]),
        ("Released under the MIT\nLicense", ["MIT"]), ("# under the GNU General\n# Public License, version 3", ["GPL-3.0"]),
        ("CC0", ["CC0-1.0"]), ("CC BY 4.0", ["CC-BY-4.0"]), ("A photo (CC BY-SA 3.0)", ["CC-BY-SA-3.0"]), ("accent", []),
        ("The MIT Licence", ["MIT"]), ("the GNU General Public Licence, version 3", ["GPL-3.0"]),
        ("GNU Lesser General Public License as published by the Free Software Foundation, version 2.1", ["LGPL-2.1"]),
        ("GNU Affero General Public License as published by the Free Software Foundation, either version 3", ["AGPL-3.0"]),
        ("This permission " + "goes on and on " * 100 + "under the MIT License", ["MIT"]),
        ("Header\nCopyright 2020 X\nAll rights reserved", ["All-Rights-Reserved"]), ("MIT License\n" * 3, ["MIT"] * 3),
    ],
)
def test_license_rules_over_lines(text, names):
    assert [x[0] for x in licenses.recognised(list(licenses.licence_sentences(text)))] == names


def test_license_sentence_places():
    text = "Menu\nHome\nCopyright 2020 X\nAll rights reserved"
    assert [text[a:b] for _, _, a, b in licenses.recognised(list(licenses.licence_sentences(text)))] == ["Copyright 2020 X\nAll rights reserved"]
    assert len(list(licenses.licence_sentences("mit license " * 20_000))) == 20_000


def test_license_scan(spark, odd, none):
    assert licenses.scan(odd).count() == 0 and licenses.scan(none).count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    marks = {"GPL-3.0": "GNU General Public License, version 3", "MIT": "MIT License", "Apache-2.0": "Apache License, Version 2.0", "CC-BY-NC-4.0": "CC BY-NC 4.0", "All-Rights-Reserved": "All rights reserved"}
    expected = Counter()
    for r in docs.collect():
        for name, mark in marks.items():
            expected[r.doc_id, name] += r.text.lower().count(mark.lower())
    assert Counter((r.doc_id, r.licence) for r in licenses.scan(docs).collect()) == +expected


def test_every_dealt_query_is_registered():
    names = entry.queries()
    assert all(sum(q.startswith(f"op{n}_") for q in names) == 1 for n in range(1, 11)) and "pipeline" in names
