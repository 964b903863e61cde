import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphloom.functions import labels as L
from glyphloom.functions import predictions as P
from glyphloom.functions import ranking
from glyphloom.functions import scores as S
from glyphloom.operators import arbitration, curate, losses, matching, quality, scoring
from glyphloom.plans import page_layout
from glyphloom.sources import feedback_log, folders, manifests, strokes


def write(root, *names, data=b"x"):
    for name in names:
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return str(root)


# ---------------------------------------------------------------- folders


def test_labelled_folder(spark, tmp_path):
    root = write(tmp_path, "A/x.png", "b/deep/y.JPG", "0/z.bmp", "A/notes.txt", "loose.png")
    out = folders.load_labelled_folder(spark, root, L.vocabulary(spark, L.FOLDED_LABELS))
    assert sorted((r.label_folder, r.target) for r in out.collect()) == [("0", 0), ("A", 10), ("b", 11)]


def test_labelled_folder_errors(spark, tmp_path):
    root = write(tmp_path / "bad", "A/x.png", "zz/x.png", "??/x.png")
    with pytest.raises(ValueError, match=r"folders: \?\?, zz"):
        folders.load_labelled_folder(spark, root, L.vocabulary(spark, L.FOLDED_LABELS))
    with pytest.raises(ValueError, match="no supported images"):
        folders.load_labelled_folder(spark, write(tmp_path / "none", "A/x.txt"), L.vocabulary(spark, L.FOLDED_LABELS))


def test_code_folders(spark, tmp_path):
    root = write(tmp_path, "97/a.png", "65/a.png", "65/b.png", "65/deep/c.png", "notes/x.png", "66/d.jpg")
    samples, vocab = folders.base_code_samples(folders.list_files(spark, root))
    assert sorted((r.label, r.target) for r in samples.collect()) == [("A", 0), ("A", 0), ("a", 2)]
    assert [r.label for r in vocab.orderBy("idx").collect()] == ["A", "B", "a"]
    extra, bad = folders.extra_code_samples(folders.list_files(spark, root), L.vocabulary(spark, ["A"]))
    assert extra.count() == 2
    with pytest.raises(ValueError, match="notes"):
        folders.require_code_folders(bad)
    with pytest.raises(ValueError, match="notes"):
        folders.mixed_code_samples(folders.list_files(spark, root), L.vocabulary(spark, L.MIXED_LABELS))
    counts = folders.exported_crop_counts(folders.list_files(spark, root)).collect()
    assert {r.label: r["count"] for r in counts} == {"A": 3, "a": 1}


def test_hex_and_sample_folders(spark, tmp_path):
    root = write(tmp_path, "by_class/4a/h/x.png", "by_class/4a/h/y.png", "by_class/6a/h/z.PNG", "by_class/zz/h/q.png", "by_class/4a/q.png", "other/4a/h/x.png", data=b"img")
    out = folders.load_hex_samples(spark, root, n=1)
    assert sorted((r.target, bytes(r.content)) for r in out.collect()) == [(19, b"img"), (45, b"img")]
    paths = folders.list_files(spark, write(tmp_path / "s", "Sample001/a.png", "Sample011/a.png", "Sample037/a.png", "Sample063/a.png", "x/a.png"))
    assert sorted(r.target for r in folders.numbered_samples(paths).collect()) == [0, 10, 10]
    assert sorted(r.target for r in folders.numbered_samples(paths, fold_case=False).collect()) == [0, 10, 36]


def test_only_chosen_files_are_opened(spark, tmp_path):
    root = write(tmp_path, "by_class/4a/h/x.png", "by_class/4b/h/odd name %41#?é.png", data=b"img")
    (tmp_path / "by_class" / "zz" / "h").mkdir(parents=True)
    (tmp_path / "by_class" / "zz" / "h" / "locked.png").write_bytes(b"x" * 10)
    opened = spark.sparkContext.accumulator(0)

    def counting(path):
        opened.add(1)
        assert "locked" not in path
        return folders.read_bytes(path)

    chosen = folders.balanced_hex_samples(folders.list_files(spark, root), 5)
    got = folders.read_files(chosen, counting)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("Scan binaryFile" if "Scan binaryFile" in plan else "BatchScan")[-1].split("]")[0]
    rows = got.collect()
    assert sorted((r.target, bytes(r.content)) for r in rows) == [(19, b"img"), (20, b"img")] and opened.value == 2
    assert {r.rel for r in rows} == {"by_class/4a/h/x.png", "by_class/4b/h/odd name %41#?é.png"}
    missing = spark.createDataFrame([(f"file:{tmp_path}/none.png", "r")], "path string, rel string")
    with pytest.raises(Exception, match="cannot read file:.*none.png"):
        folders.read_files(missing).collect()
    assert folders.read_files(missing.limit(0)).count() == 0


def test_written_files_are_whole_and_read_back(spark, tmp_path):
    rows = [(f"d{k % 3}/f{k}.bin", bytes([k]) * k) for k in range(1, 51)]
    df = spark.createDataFrame(rows, "rel string, content binary").repartition(4)
    for _ in range(2):  # a second run writes the same files again
        assert folders.write_files(df, f"file:{tmp_path}/out") == 50
    listed = folders.list_files(spark, str(tmp_path / "out"))
    assert sorted((r.rel, bytes(r.content)) for r in folders.read_files(listed).collect()) == sorted(rows)
    assert not [p for p in (tmp_path / "out").rglob(".*") if p.is_file() and not p.name.endswith(".crc")]


@pytest.mark.parametrize("uri, inside", [("/a/b c", "/a/b c"), ("file:/a/%41", "/a/%41"), ("file:///a/b#?", "/a/b#?"), ("/a:b/c", "/a:b/c")])
def test_local_paths_as_spark_writes_them(uri, inside):
    store, path = folders.store_of(uri)
    assert store.type_name == "local" and path == inside


def test_checksums(spark):
    files = spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b"2"))], "filename string, content binary")
    good = hashlib.md5(b"1").hexdigest()
    manifest = spark.createDataFrame([("a", good), ("b", good), ("c", good)], "filename string, md5 string")
    assert sorted(r.filename for r in folders.checksum_errors(files, manifest).collect()) == ["b", "c"]
    with pytest.raises(ValueError, match="b md5 mismatch"):
        folders.require_checksums(files, manifest)


# ---------------------------------------------------------------- manifests, strokes, files


def test_manifest_subset(spark, tmp_path):
    csv = tmp_path / "labels.csv"
    csv.write_text("path,symbol_id,latex,user_id\na.png,1,A,1\nb.png,2,a,1\nc.png,3,\\alpha,1\nd.png,4,+,1\n")
    manifest = manifests.read_manifest(spark, str(csv))
    assert sorted(r.label for r in manifests.manifest_subset(manifest, "alnum").collect()) == ["A", "A"]
    subset = manifests.manifest_subset(manifest, "ascii")
    files = spark.createDataFrame([(p, bytearray(b"x")) for p in ("a.png", "b.png", "d.png")], "path string, content binary")
    counts = manifests.write_manifest_subset(subset, files, str(tmp_path / "out"))
    assert {r.label: r["count"] for r in counts.collect()} == {"65": 1, "97": 1, "43": 1}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    with pytest.raises(ValueError, match="d.png"):
        manifests.write_manifest_subset(subset, files.filter("path <> 'd.png'"), str(tmp_path / "out2"))
    with pytest.raises(ValueError, match="Unsupported"):
        manifests.manifest_subset(manifest, "other")


def test_strokes(spark):
    text = """
// comment
WORD A trn_W01-01
  NUMSTROKES 2
  POINTS 3 # 0 10 5 0 10 10
  POINTS 2 # 2 6 8 6
WORD euro trn_W01-01
  NUMSTROKES 1
  POINTS 2 # 0 0 10 10
WORD B one two
WORD C lost
  NUMSTROKES 1
  POINTS 1 # 1 1
WORD D s
  NUMSTROKES 3
  POINTS 1 # 4 5
  junk
WORD E swallowed
  NUMSTROKES 1
  POINTS 1 # 7 7
"""
    df = spark.createDataFrame([("f", text)], "path string, value string")
    out = strokes.parse_strokes(df).orderBy("line").collect()
    got = [(r.label, r.session, [[(p.x, p.y) for p in s] for s in r.strokes]) for r in out]
    assert got == [("A", "trn_W01-01", [[(0, 10), (5, 0), (10, 10)], [(2, 6), (8, 6)]]), ("D", "s", [[(4, 5)]])]
    n = strokes.parse_strokes(df).filter("label = 'A'").select(strokes.normalize_strokes(F.col("strokes")).alias("s")).first().s
    assert [(p.x, p.y) for p in n[0]] == [(10, 86), (48, 10), (86, 86)]


def test_one_large_pen_file_is_read_by_many_tasks(spark, tmp_path, monkeypatch):
    """Records cross the borders of splits; some overlap, some are cut short; numbers and records are those of the whole file."""

    import random

    rng = random.Random(4)
    lines = []
    for k in range(3000):
        lines.append(rng.choice((f"WORD {rng.choice('ABC')} s_{k}", f"WORD {rng.choice('xyz')} s{k} more", "// note", "")))
        if rng.random() < 0.8:
            n = rng.choice((0, 1, 2, 3, 40))
            lines.append(f"  NUMSTROKES {n}")
            for _ in range(rng.choice((n, n, max(0, n - 1)))):
                lines.append(rng.choice(("  POINTS 2 # 1 2  3 4", "POINTS 3 # 5 6 7 8 9 10", "junk", "POINTS x")))
    text = "\r\n".join(lines[:2000]) + "\r\n" + "\n".join(lines[2000:])
    (tmp_path / "pen.txt").write_text(text)
    (tmp_path / "small.txt").write_text("WORD A s\nNUMSTROKES 1\nPOINTS 1 # 3 4")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        read = strokes.read_stroke_lines(spark, str(tmp_path)).cache()
        assert read.select("path", "block").distinct().count() > 20
        numbered = {(r.path.rsplit("/", 1)[1], r.line): r.text for r in read.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    plain = {("pen.txt", k): " ".join(line.split()) for k, line in enumerate(lines)} | {("small.txt", k): t for k, t in enumerate(("WORD A s", "NUMSTROKES 1", "POINTS 1 # 3 4"))}
    assert numbered == plain
    got = sorted((r.path.rsplit("/", 1)[1], r.line, r.label, r.session, r.strokes) for r in strokes.parse_stroke_lines(read).collect())
    whole = spark.createDataFrame([("pen.txt", text), ("small.txt", "WORD A s\nNUMSTROKES 1\nPOINTS 1 # 3 4")], "path string, value string")
    monkeypatch.setattr(strokes, "BLOCK_LINES", 10**9)
    wanted = sorted((r.path, r.line, r.label, r.session, r.strokes) for r in strokes.parse_strokes(whole).collect())
    assert got == wanted and len(got) > 100
    # One by one: a line inside an earlier record opens none.
    at, opened = -1, []
    for k, line in enumerate(" ".join(x.split()) for x in lines):
        head = line.split(" ")
        if k > at and head[0] == "WORD" and len(head) >= 3:
            following = lines[k + 1].split() if k + 1 < len(lines) else []
            n = int(following[1]) if following[:1] == ["NUMSTROKES"] else None
            at = k + 1 + (n or 0)
            if n and any(" ".join(x.split()).startswith(("POINTS 2 ", "POINTS 3 ")) for x in lines[k + 2 : k + 2 + n]):
                opened.append(k)
    assert [line for path, line, *_ in got if path == "pen.txt"] == opened


def test_vocabulary_and_snapshot(spark, tmp_path):
    vocab = L.vocabulary(spark, ["A", "\"", "é"])
    manifests.write_vocabulary(vocab, str(tmp_path / "v"))
    assert [r.label for r in manifests.read_vocabulary(spark, str(tmp_path / "v")).orderBy("idx").collect()] == ["A", "\"", "é"]
    key = manifests.fingerprint(["a", "b"])
    assert len(key) == 12 and key != manifests.fingerprint(["b", "a"]) and key != manifests.fingerprint(["a", "b"], cap=3)
    built = []
    build = lambda: built.append(1) or spark.range(5)
    for _ in range(2):
        assert manifests.snapshot(spark, str(tmp_path), key, build).count() == 5
    assert built == [1]


def test_metric_files(spark, tmp_path):
    (tmp_path / "list.json").write_text(json.dumps([{"epoch": 1, "test_accuracy": 97.0}, {"epoch": 2, "test_accuracy": 99.0}]))
    (tmp_path / "obj.json").write_text(json.dumps({"history": [{"epoch": 1, "test_accuracy": 50}], "best_checkpoint": {"test_accuracy": 60}, "x_best_checkpoint": {"epoch": 9}, "extra_roots": ["r1"]}))
    (tmp_path / "bad.json").write_text("{oops")
    raw = manifests.read_metric_candidates(spark, [str(tmp_path / f) for f in ("list.json", "obj.json", "bad.json")])
    flat = raw.withColumn("test_accuracy", F.col("metrics")["test_accuracy"].cast("double"))
    best = {r.file: r.test_accuracy for r in quality.best_checkpoint(flat, "test_accuracy", ["file"]).collect()}
    assert best == {"list.json": 99.0, "obj.json": 60.0}
    assert raw.count() == 5


def test_crop_export_replaces(spark, tmp_path):
    items = spark.createDataFrame([("i", 3, 1, "A", 2, 1, 3, 2)], "image_id string, record_index int, item_index int, label string, x0 int, y0 int, width int, height int")
    ink = spark.createDataFrame([("i", y, x) for y in range(5) for x in range(9)], "image_id string, y int, x int")
    for _ in range(2):
        feedback_log.export_crops(items, ink, str(tmp_path / "crops"))
    out = spark.read.parquet(str(tmp_path / "crops"))
    assert out.count() == 6 and out.first().name == "00003_01" and out.first().code == 65


# ---------------------------------------------------------------- curation


def test_hot_class_ranks_and_caps(spark):
    df = spark.range(4000).select(F.col("id").alias("sample_id"), F.when(F.col("id") % 5 < 4, 0).otherwise(F.col("id") % 7).cast("int").alias("target"))
    wanted = {}
    for r in df.collect():
        wanted.setdefault(r.target, []).append((hashlib.md5(f"42|{r.sample_id}".encode()).hexdigest(), r.sample_id))
    ranked = ranking.hashed_rank(df, ["target"], ranking.seeded_hash(42, F.col("sample_id")), "sample_id", digits=1)
    for target, pairs in wanted.items():
        got = [r.sample_id for r in ranked.filter(F.col("target") == target).orderBy("rank").collect()]
        assert got == [i for _, i in sorted(pairs)]
    capped = curate.cap_per_class(df, 100, 42)
    assert {r.sample_id for r in capped.collect()} == {i for p in wanted.values() for _, i in sorted(p)[:100]}
    split = curate.stratified_split(df)
    held = {r.sample_id for r in split.filter("split = 'validation'").collect()}
    assert held == {i for p in wanted.values() for _, i in sorted(p)[: (15 * len(p) + 50) // 100]}
    assert split.count() == 4000


def test_first_n_beyond_the_optimizer_limit(spark):
    df = spark.range(6000).withColumn("k", F.col("id") % 2)
    out = ranking.first_n(df, ["k"], [F.col("id")], 1500)
    assert out.count() == 3000 and out.agg(F.max("id")).first()[0] == 2999


def test_draw_is_balanced(spark):
    df = spark.range(2000).select(F.col("id").alias("sample_id"), (F.col("id") % 10 == 0).cast("int").alias("target"))
    draw = curate.weighted_draw(df, 1)
    assert draw.count() == 2000
    assert abs(draw.filter("target = 1").count() - 1000) < 120


def test_mixed_weights(spark):
    vocab = L.vocabulary(spark, ["common", "rare"])
    counts = spark.createDataFrame([(0, 100), (1, 25)], "target int, class_rows long")
    out = [r.weight for r in curate.mixed_loss_weights(vocab, counts=counts, balance_strength=0.5).orderBy("idx").collect()]
    assert out == pytest.approx([0.7905694, 1.5811388], abs=1e-6)
    assert curate.mixed_loss_weights(vocab) is None and curate.character_loss_weights(vocab) is None


def test_vocabulary_checks(spark):
    a, b = L.vocabulary(spark, ["A", "B"]), L.vocabulary(spark, ["B", "A"])
    with pytest.raises(ValueError):
        curate.require_same_vocabulary(a, b)
    curate.require_same_vocabulary(a, a)
    with pytest.raises(ValueError):
        curate.keep_source_targets(spark.createDataFrame([(0,)], "target int"), a, b)


# ---------------------------------------------------------------- quality, scores


def test_mixed_breakdown(spark):
    df = spark.createDataFrame([("S", "S"), ("s", "S"), ("0", "O"), ("T", "7")], "expected string, predicted string")
    m = quality.mixed_breakdown(df).first()
    assert (m.test_accuracy, m.casefold_test_accuracy, m.ambiguity_aware_test_accuracy, m.case_or_ambiguity_aware_test_accuracy) == (25, 50, 75, 100)
    assert (m.digit_ambiguity_aware_test_accuracy, m.upper_ambiguity_aware_test_accuracy, m.lower_ambiguity_aware_test_accuracy, m.lower_case_or_ambiguity_aware_test_accuracy) == (100, 100, 0, 100)


def test_punctuation_group_and_empty_input(spark):
    df = spark.createDataFrame([(".", "'"), ("'", "'"), ("A", "A")], "expected string, predicted string")
    top = quality.top_confusions_by_group(quality.confusions(df)).collect()
    assert [(r.grp, r.expected, r.predicted, r["count"]) for r in top] == [("punctuation", ".", "'", 1)]
    assert quality.character_breakdown(df).first().punctuation_validation_accuracy == 50.0
    empty = quality.character_breakdown(df.limit(0)).first()
    assert empty.validation_accuracy == 0.0
    none = spark.createDataFrame([], "image_id string, target string")
    assert quality.replay_accuracy(none, spark.createDataFrame([], "image_id string, sequence string")).first().accuracy == 0.0


def test_gates_fail_without_a_value(spark):
    metrics = spark.createDataFrame([("digit", "test_accuracy", 99.65), ("mixedcase", "test_accuracy", 80.5)], "model string, metric string, value double")
    out = {r.name: r.passed for r in quality.quality_gates(quality.gate_definitions(spark), metrics).collect()}
    assert out["digit_specialist_exact"] and not out["mixedcase_exact"] and not out["character_exact"] and len(out) == 8


def test_score_functions(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(20, 62)) * 4
    t = rng.integers(0, 62, 20)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], int(t[i])) for i in range(20)], "id int, scores array<double>, target int")
    lse = lambda a: np.log(np.exp(a).sum(axis=-1))
    out = df.orderBy("id").select(S.softmax(F.col("scores")).alias("p"), S.fold_case_scores(F.col("scores")).alias("f"), S.type_scores(F.col("scores")).alias("k")).collect()
    assert np.allclose([r.p for r in out], np.exp(x - lse(x)[:, None]))
    fold = np.concatenate([x[:, :10], np.logaddexp(x[:, 10:36], x[:, 36:])], axis=1)
    assert np.allclose([r.f for r in out], fold)
    assert np.allclose([r.k for r in out], np.stack([lse(x[:, :10]), lse(x[:, 10:36]), lse(x[:, 36:])], axis=1))
    w = np.where(np.arange(62) % 3 == 0, 2.0, 1.0)
    logp = x - lse(x)[:, None]
    ce = 0.9 * -logp[np.arange(20), t] * w[t] + 0.1 * -(logp * w).sum(1) / 62
    focal = (1 - np.maximum(np.exp(logp[np.arange(20), t]), 1e-6)) ** 1.5
    weights = F.array(*[F.lit(float(v)) for v in w])
    assert losses.focal_loss(df, weights, 0.1, 1.5).first()[0] == pytest.approx((focal * ce).mean())
    assert losses.weighted_loss(df, weights, 0.1).first()[0] == pytest.approx(ce.sum() / w[t].sum())


def test_nearest_exemplar_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    bank, queries = rng.normal(size=(50, 8)), rng.normal(size=(40, 8))
    bank[10] = bank[3]
    queries[0] = bank[10]
    b = spark.createDataFrame([(i, f"l{i % 5}", [float(v) for v in bank[i]]) for i in range(50)], "sample_id long, label string, vec array<double>")
    q = spark.createDataFrame([(i, [float(v) for v in queries[i]]) for i in range(40)], "qid long, vec array<double>").repartition(4)
    d = np.sqrt(((queries[:, None, :] - bank[None]) ** 2).sum(-1))
    for limit in (10**9, 100):
        monkeypatch.setattr(matching, "MAX_BLOCK_VALUES", limit)
        out = matching.nearest_exemplar(q, b, ["qid"]).orderBy("qid").collect()
        assert [r.exemplar_id for r in out] == d.argmin(1).tolist()
        assert np.allclose([r.distance for r in out], d.min(1))
    assert out[0].exemplar_id == 3


def test_nearest_exemplar_of_many_blocks_and_ties(spark, monkeypatch):
    """Points on a lattice, in far clusters, so that ties are many and most blocks are out of reach."""

    monkeypatch.setattr(matching, "MAX_BLOCK_VALUES", 90)
    monkeypatch.setattr(matching, "CHUNK_QUERIES", 50)
    rng = np.random.default_rng(5)
    centres = rng.integers(-300, 300, size=(12, 3))
    bank = centres[rng.integers(0, 12, 900)] + rng.integers(-2, 3, size=(900, 3))
    queries = np.concatenate([centres[rng.integers(0, 12, 150)] + rng.integers(-4, 5, size=(150, 3)), rng.integers(-400, 400, size=(30, 3))])
    ids = rng.permutation(900)
    b = spark.createDataFrame([(int(i), f"l{i}", v.astype(float).tolist()) for i, v in zip(ids, bank)], "sample_id long, label string, vec array<double>").repartition(5)
    q = spark.createDataFrame([(k, v.astype(float).tolist()) for k, v in enumerate(queries)], "qid long, vec array<double>").repartition(4)
    d = np.sqrt(((queries[:, None, :] - bank[None]) ** 2).sum(-1).astype(float))
    visited = []
    whole = matching._blocks_in_reach

    def watched(*args):
        visited.append(whole(*args))
        return visited[-1]

    monkeypatch.setattr(matching, "_blocks_in_reach", watched)
    out = matching.nearest_exemplar(q, b, ["qid"]).orderBy("qid").collect()
    for k, r in enumerate(out):
        least = d[k].min()
        assert r.exemplar_id == min(ids[j] for j in np.flatnonzero(d[k] == least)) and r.distance == pytest.approx(least)
        assert r.exemplar_label == f"l{r.exemplar_id}"
    assert len(out) == len(queries) and visited[0].count() < len(queries) * 8  # of some forty blocks each
    none = matching.nearest_exemplar(q, b.limit(0), ["qid"]).collect()
    assert len(none) == len(queries) and all(r.exemplar_id is None and r.distance is None for r in none)
    assert matching.nearest_exemplar(q.limit(0), b, ["qid"]).count() == 0


def test_scorer_and_baseline(spark):
    df = spark.createDataFrame([(i, [float(i % 2), 1.0 - i % 2], i % 2) for i in range(40)], "sample_id long, vec array<double>, target int")
    scored = scoring.score_vectors(df, lambda v: v * 2, region="sample_id").orderBy("sample_id").collect()
    assert scored[1].scores == [2.0, 0.0]
    model, accuracy = scoring.train_best_baseline(df, df, 2, seeds=[1, 2], hidden=[4], iterations=40)
    assert accuracy == 100.0
    assert scoring.baseline_predictions(model, df).filter("target <> predicted_target").count() == 0


def test_prediction_notes(spark):
    alts = [("O", 0.4), ("0", 0.45), ("", 0.9), ("Q", 0.1)]
    df = spark.createDataFrame([("0", 0.85, alts)], "shown string, confidence double, alternatives array<struct<label:string,confidence:double>>")
    top = df.withColumn("top", P.top_guesses(F.col("alternatives")))
    r = top.select("top", P.is_uncertain(F.col("shown"), F.col("confidence"), F.col("top")).alias("u"), P.ambiguity_note(F.col("shown"), F.col("confidence"), F.col("top")).alias("n")).first()
    assert [g.label for g in r.top] == ["0", "O", "Q"] and r.u and r.n == "ambiguous with O 40.0%"


def test_arbitration_uses_what_is_there(spark):
    regions = spark.createDataFrame([(1, 0, 0, 30, 60, "4", 0.95), (2, 0, 0, 30, 60, "Z", 0.9), (3, 0, 0, 30, 60, "x", 0.5)], "region_id int, x0 int, y0 int, x1 int, y1 int, label string, confidence double")
    shapes = spark.createDataFrame([(1, "(")], "region_id int, punctuation string")
    digits = spark.createDataFrame([(2, "2", 0.99)], "region_id int, digit_label string, digit_confidence double")
    near = spark.createDataFrame([(3, "k", 16.0)], "region_id int, exemplar_label string, distance double")
    out = arbitration.arbitrate(arbitration.gather_scores(regions, [shapes, digits, near])).orderBy("region_id").collect()
    assert [(r.label, r.confidence) for r in out] == [("(", 0.95), ("2", 0.99), ("k", 0.5)]


def test_page_text(spark):
    glyphs = [("p", 1, 1, "H", .9, 10.0, 20.0, 50.0, 90.0), ("p", 1, 2, "L", .8, 80.0, 40.0, 14.0, 70.0), ("p", 1, 3, ":", .9, 80.0, 10.0, 10.0, 10.0)]
    df = spark.createDataFrame([g + ([],) for g in glyphs], "page_id string, row int, idx int, label string, confidence double, x double, y double, width double, height double, alternatives array<struct<label:string,confidence:double>>").withColumn("shown", F.col("label"))
    out = page_layout.page_texts(df).first()
    assert (out.display, out.raw_sequence) == ("Hi", "Hi")


def test_roots_as_uri_dotted_relative_and_repeated(spark, tmp_path, monkeypatch):
    root = write(tmp_path / "base", "65/a.png", "66/b.png")
    inner = f"66{root}"
    write(tmp_path / "base", f"{inner}/deep.png")
    monkeypatch.chdir(tmp_path)
    (tmp_path / "x").mkdir()
    expected = {"65/a.png", "66/b.png", f"{inner}/deep.png"}
    for given in (root, f"file://{root}", f"file:{root}/", f"{tmp_path}/x/../base"):
        assert {r.rel for r in folders.list_files(spark, given).collect()} == expected
    counts = folders.exported_crop_counts(folders.list_files(spark, f"file://{root}"))
    assert {r.label: r["count"] for r in counts.collect()} == {"A": 1, "B": 2}


def test_checkpoints_follow_the_history(spark):
    rows = [("other_best_checkpoint", 0, 0.5), ("history", 7, 0.5), ("best_checkpoint", 0, 0.5), ("another_best_checkpoint", 0, 0.5)]
    table = spark.createDataFrame(rows, "kind string, position int, m double")
    assert quality.best_checkpoint(table, "m").first().kind == "history"
    assert quality.best_checkpoint(table.filter("kind <> 'history'"), "m").first().kind == "best_checkpoint"
    assert quality.best_checkpoint(table.filter("kind like '%other%'"), "m").first().kind == "another_best_checkpoint"


def test_stroke_files_hold_one_order_each(spark):
    from glyphloom.plans import feedback_catalog

    root = "/root/testdata/sf0.001"
    files = feedback_catalog.stroke_files(spark, root).collect()
    assert len(files) == len({f.path for f in files}) == spark.read.parquet(f"{root}/orders.parquet").count()
    assert all(f.value.count("WORD ") == 1 for f in files)


def test_folders_are_listed_in_tasks_as_spark_lists_them(spark, tmp_path, monkeypatch):
    for rel, text in {
        "65/a.png": "x", "65/b c%20.png": "yy", "65/empty.png": "", "_hidden/a.png": "x", ".dot/a.png": "x", "k=1/_x=2.png": "x", "66/_skip.png": "x",
        "66/deep/er/c.png": "zzz", "66/d._COPYING_": "x", "top.png": "x", "_metadata_x/f.png": "x",
    }.items():
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_text(text)
    (tmp_path / "nothing").mkdir()
    rows = lambda df: sorted(map(tuple, df.collect()))
    listed = folders.list_in_tasks(spark, str(tmp_path))
    assert listed.inputFiles() and not any(str(tmp_path) in f for f in listed.inputFiles())  # the files themselves aren't in the plan
    by_spark = rows(folders.list_files(spark, str(tmp_path)))
    assert rows(listed) == by_spark and len(by_spark) >= 5
    monkeypatch.setattr(folders, "_lists_folder", lambda uri: False)
    assert rows(folders.list_in_tasks(spark, str(tmp_path))) == by_spark
