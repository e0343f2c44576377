"""Token counts, media columns, the quality classifier and the pipeline, against plain computations."""

import hashlib
import random
import wave
import zlib
from io import BytesIO

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import bpe, media, quality, token_counts
from quern.llm import queries as q

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def lengths(texts):
    import base64

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return [len(e.encode_ordinary(t or "")) for t in texts]


def test_context_table_matches_plain_sums(spark):
    d = "/root/testdata/sf0.001"
    ns = lengths([r.text for r in spark.read.parquet(f"{d}/documents.parquet").select("text").collect()])
    rows = q.op5_token_counts(spark, d).collect()
    assert sorted(r.length for r in rows) == sorted(set(ns))
    for r in rows:
        above = [n for n in ns if n >= r.length]
        assert (r.n_docs, r.docs_from, r.tokens_from, r.tokens_total) == (ns.count(r.length), len(above), sum(above), sum(ns))
        assert r.truncated_total == sum(min(n, r.length) for n in ns)
        assert r.share_within == pytest.approx(sum(n <= r.length for n in ns) / len(ns))


def test_histograms_across_blocks_and_limits(spark):
    df = spark.createDataFrame([(n,) for n in [0, 1, 1, 5000, 9000, 9000, None]], "n_tokens long")
    h = token_counts.histogram(df)
    assert {r.length: r.truncated_total for r in token_counts.context_table(h).collect()} == {0: 0, 1: 5, 5000: 15002, 9000: 23002}
    assert {r.limit: (r.tokens, r.docs_cut) for r in token_counts.truncated_totals(h, [0, 2, 10_000]).collect()} == {0: (0, 5), 2: (8, 3), 10_000: (23002, 0)}
    assert token_counts.quantile(h, 0.5).first().length == 1
    assert token_counts.context_table(token_counts.histogram(df.where("false"))).count() == 0


def test_limits_that_repeat_and_no_documents(spark):
    h = spark.createDataFrame([(16, 2)], "length long, n_docs long")
    assert [tuple(r) for r in token_counts.truncated_totals(h, [6, 6]).collect()] == [(6, 12, 2)]
    assert [tuple(r) for r in token_counts.truncated_totals(h.where("false"), [6]).collect()] == [(6, 0, 0)]
    assert token_counts.truncated_totals(h, []).count() == 0


def test_token_counts_of_awkward_texts(spark):
    blanks = " " * 1_000_000
    texts = [None, "", blanks, blanks + "word", "a" + blanks + "\nb\t" + blanks, "no " * 200_000, "\n" * 150_000 + "x", "\x1c" * 120_000 + " y"]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    rows = {r.doc_id: r.n_tokens for r in token_counts.with_lengths(df, RANKS, public_tokenizers.PATTERN).collect()}
    assert [rows[k] for k in (0, 1, 2, 3, 4)] == [0, 0, 10**6, 10**6, 2 * 10**6 + 4]
    assert [rows[k] for k in (5, 6, 7)] == lengths(texts[5:])
    short = [t.replace(blanks, " " * 150_000) for t in texts[2:5]]  # the library can still say these
    df = spark.createDataFrame(list(enumerate(short)), "doc_id long, text string")
    assert [r.n_tokens for r in sorted(token_counts.with_lengths(df, RANKS, public_tokenizers.PATTERN).collect())] == lengths(short)
    assert token_counts.with_lengths(df.where("false"), RANKS, public_tokenizers.PATTERN).count() == 0


def test_media_query(spark):
    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = q.op6_media(spark, d).collect()
    assert len(rows) == len(docs)
    for r in rows:
        data = docs[r.doc_id].encode()
        payload = data + b"\xff" * (-len(data) % 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.media_sha256 == hashlib.sha256(media.to_wav(payload)).hexdigest() and r.media_bytes == len(media.to_wav(payload))


def test_media_of_awkward_texts(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "a" * 576, 0), (4, "a" * 576, 0), (5, "xy" * 40_000, 0)], "doc_id long, text string, media int")
    rows = {r.doc_id: r for r in media.as_sound(df).collect()}
    assert rows[1].payload == rows[2].payload == b"\xff" * 576
    assert rows[3].media == rows[4].media and list(rows[3].codes) == list(rows[4].codes)
    with wave.open(BytesIO(bytes(rows[5].media))) as w:
        assert (w.getsampwidth(), w.getnframes()) == (1, len(rows[5].payload))
    assert media.as_sound(df.where("false")).count() == 0


def test_fingerprints_find_a_tone_and_do_not_depend_on_the_batch():
    t = np.arange(576 * 6)
    tone = (128 + 100 * np.sin(2 * np.pi * 30 * t / 576)).astype(np.uint8)
    bins, _ = media.band_peaks(tone)
    assert (bins[:, 1] == 30).all()
    rng = random.Random(3)
    wavs = [media.to_wav(bytes(rng.choices(range(256), k=576 * n))) for n in (1, 4, 2)]
    _, times, codes = media.listener(wavs)
    for k, w in enumerate(wavs):
        _, t1, c1 = media.listener([w])
        assert times[k].as_py() == t1[0].as_py() and codes[k].as_py() == c1[0].as_py()


def plain_feature(payload):
    """Times and codes by the module's rules, with a transform written out as sums."""
    frames = [payload[i : i + 576] for i in range(0, len(payload) - 575, 288)]
    k, t = np.arange(289)[:, None], np.arange(576)[None, :]
    turn = np.exp(-2j * np.pi * k * t / 576)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(576) / 575)
    spectra = [np.abs(turn @ ((np.frombuffer(f, np.uint8).astype(float) - 128) * window)) * 16 for f in frames]
    peaks = []
    for n, s in enumerate(spectra):
        for lo, hi in ((2, 18), (18, 48), (48, 110), (110, 289)):
            best = lo + int(np.argmax(np.floor(s[lo:hi])))
            size = lambda m: int(max(np.floor(spectra[m][lo:hi]))) if 0 <= m < len(spectra) else -1  # noqa: B023, E731
            if size(n) > size(n - 1) and size(n) >= size(n + 1) and size(n) > 0:
                peaks.append((n, best))
    out = [(t0, f0 << 20 | f1 << 8 | t1 - t0) for i, (t0, f0) in enumerate(peaks) for t1, f1 in peaks[i + 1 : i + 4] if t1 - t0 <= 15]
    return sorted(out, key=lambda x: (x[0], x[1]))


def test_feature_matches_plain_transforms(spark):
    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows, same, pairs = q.op6_media(spark, d).collect(), 0, 0
    for r in rows:
        data = docs[r.doc_id].encode()
        expected = {f"{c:x}@{t}" for t, c in plain_feature(data + b"\xff" * (-len(data) % 576))}
        got = set(r.feature.split(",")) - {""}
        assert r.n_pairs == len(r.feature.split(",")) - (r.feature == "")
        same, pairs = same + len(got & expected), pairs + len(got | expected)
    assert same >= 0.995 * pairs > 1000  # rounding of single precision may move a peak between equals


def graded(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(4000)]
    out = []
    for k in range(n):
        text, g = rng.choices(words, k=rng.randint(30, 200)), rng.choices([0, 1, 2], [2, 2, 6])[0]
        if g == 0:
            text = [w.upper() + "!!" for w in text]
        if g == 1:
            for _ in range(4):
                text.insert(rng.randrange(len(text)), rng.choice(["nasty", "vile"]))
        out.append((k, " ".join(text), g))
    return out


def test_classifier_is_accurate_on_texts_it_has_not_seen(spark):
    train, test = graded(900, 1), graded(400, 2)
    df = spark.createDataFrame(train, "doc_id long, text string, g int")
    model = quality.train(df.select("doc_id", "text"), df.selectExpr("doc_id", "g AS grade"), 3)
    assert model.thresholds[0] < model.thresholds[1]
    rows = quality.grade(spark.createDataFrame(test, "doc_id long, text string, g int"), model).collect()
    assert np.mean([round(r.expected_grade) == r.g for r in rows]) > 0.95
    assert all(0 <= r.tail_probability <= 1 and r.tail_probability <= r.expected_grade <= 2 for r in rows)


def plain_features(text):
    """Buckets of a text as the module's docstring has them, token by token."""
    import string
    tokens, found, loud, odd = (text or "").split(), set(), 0, 0
    crc = lambda kind, value: zlib.crc32(f"{kind}:{value}".encode()) % quality.BUCKETS
    for t in tokens:
        i, j = 0, len(t)
        while i < j and not t[i].isalnum():
            i += 1
        while j > i and not t[j - 1].isalnum():
            j -= 1
        inside = {c for c in t if not c.isalnum()}
        word = t.strip("".join(inside))
        marks = t.replace(word, " ", 1) if word else t
        found.add(crc("word", word.lower()))
        if marks.strip(" .,;:?'\"()-"):
            odd += 1
            found.add(crc("marks", marks))
        loud += len(word) > 1 and word.isupper()
    again = sum(a == b for a, b in zip(tokens, tokens[1:], strict=False))
    for name, x in (("loud", loud), ("odd", odd), ("again", again)):
        found.add(crc("share", f"{name} {1 + int(9 * x / len(tokens)) if x else 0}"))
    return found


def test_query_scores_match_plain_sums(spark):
    d = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    model = quality.train(spark.read.parquet(f"{d}/documents.parquet"), quality.rated(spark.read.parquet(f"{d}/labels.parquet")), quality.GRADES)
    rows = q.op10_quality(spark, d).collect()
    assert len(rows) == len(docs)
    for r in rows:
        score = sum(float(model.weights[b]) for b in plain_features(docs[r.doc_id]))
        tails = [1 / (1 + np.exp(-(score - t))) for t in model.thresholds]
        assert r.tail_probability == pytest.approx(tails[-1], abs=1e-9) and r.expected_grade == pytest.approx(sum(tails), abs=1e-9)
        assert r.keep == (r.tail_probability >= quality.KEEP)


def test_model_is_at_the_least_loss():
    """The loss by plain sums does not fall when a weight or threshold is moved either way."""
    rng = random.Random(4)
    grades = np.array([rng.randrange(3) for _ in range(240)])
    rows = [sorted({g if rng.random() < 0.8 else rng.randrange(3), 3 + rng.randrange(4)}) for g in grades]
    offsets = np.r_[0, np.cumsum([len(r) for r in rows])]
    once, quality.SCREEN_ERRORS = quality.SCREEN_ERRORS, 0.0
    distinct = quality.screened
    quality.screened = lambda values, *_: np.isin(np.arange(quality.BUCKETS), values)
    try:
        m = quality.fit(np.concatenate(rows).astype(np.int32), offsets, grades, 3)
    finally:
        quality.SCREEN_ERRORS, quality.screened = once, distinct

    def loss(w, t):
        total = 0.0
        for r, g in zip(rows, grades, strict=True):
            s = sum(w[b] for b in r)
            tail = [1.0, *[1 / (1 + np.exp(-(s - x))) for x in t], 0.0]
            total -= np.log(tail[g] - tail[g + 1])
        return total / len(rows) + quality.RIDGE / 2 * sum(x * x for x in w)

    w, t = m.weights[:7].astype(float), m.thresholds.copy()
    least = loss(w, t)
    for k in range(7):
        for h in (-0.05, 0.05):
            moved = w.copy()
            moved[k] += h
            assert loss(moved, t) >= least - 1e-6
    for k in range(2):
        for h in (-0.05, 0.05):
            moved = t.copy()
            moved[k] += h
            assert loss(w, moved) >= least - 1e-6


def test_repeated_and_long_labelled_texts_and_clashing_names(spark):
    rows = [(k % 50, ("good words " if k % 2 else "BAD!! ") * 5, "x", "y", "z") for k in range(400)] + [(60, "long " * 400_000, "x", "y", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, keep string, expected_grade string, tail_probability string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(61)], "doc_id long, quality int, toxic int")
    out = quality.judged(df, labels)
    assert sorted(out.columns) == sorted(df.columns) and out.count() == 401
    assert dict(out.dtypes)["keep"] == "boolean" and dict(out.dtypes)["expected_grade"] == "double"


def test_weights_follow_the_grades_and_rare_buckets_have_none():
    grades = np.array([0, 2] * 40)
    values = np.ravel(np.column_stack([np.where(grades == 0, 7, 9), 100 + np.arange(80)]))
    m = quality.fit(values, np.arange(0, 162, 2), grades, 3)
    assert m.weights[7] < 0 < m.weights[9] and not m.weights[100:180].any()
    tails = m.tails(np.array([m.weights[7], m.weights[9]], float))
    assert tails[0, 1] < 0.1 < 0.9 < tails[1, 1] and (tails[:, 0] >= tails[:, 1]).all()


def test_classifier_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (2, "some words"), (None, "x " * 9)], "doc_id long, text string")
    labels = spark.createDataFrame([(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.judged(df, labels).collect()
    assert len(rows) == 4 and all(r.keep for r in rows)
    assert quality.judged(df.where("false"), labels).count() == 0


def test_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    grades = quality.rated(spark.read.parquet(f"{d}/labels.parquet"))
    model = quality.train(docs, grades.where("doc_id % 3 <> 0"), 3)
    rows = quality.grade(docs.join(grades, "doc_id").where("doc_id % 3 = 0"), model).collect()
    keep = lambda g: np.mean([r.tail_probability >= quality.KEEP for r in rows if r.grade == g])
    assert keep(2) > 0.97 and keep(0) < 0.05 and keep(1) < 0.6  # a third of the toxic labels are noise


def test_pipeline_stages(spark, tmp_path):
    d = "/root/testdata/sf0.01"
    docs = before = spark.read.parquet(f"{d}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, d).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs
        if name != "encoding":
            assert docs.columns == before.columns
    ids = {n: {r.doc_id for r in f.select("doc_id").collect()} for n, f in kept.items()}
    assert ids["near_dedup"] <= ids["quality"] and ids["secrets"] == ids["near_dedup"] and ids["mixing"] <= ids["secrets"]
    assert kept["near_dedup"].select("text").distinct().count() == kept["near_dedup"].count()
    clean = {r.doc_id for r in spark.read.parquet(f"{d}/labels.parquet").where("quality = 1 AND toxic = 0").collect()}
    assert len(clean - ids["quality"]) <= 0.03 * len(clean)
    assert not kept["secrets"].where("text RLIKE '[0-9a-f]{24,}'").count()
    row = kept["encoding"].first()
    with open(corpus_pipeline.TOKENIZER, "rb") as f:
        t = bpe.Tokenizer(f.read())
    text = kept["mixing"].where(f"doc_id = {row.doc_id}").first().text
    assert [i for c in t.chunks(text) for w in t.words(c) for i in t.merge([w])[0]] == list(row.ids) and row.n_tokens == len(row.ids)


def test_every_stage_against_plain_computations(spark, tmp_path):
    import re

    from tests.llm.test_bpe import Library
    from tests.llm.test_native import brute_base, brute_targets
    from tests.llm.test_simhash import kept_by_brute_force

    d, rows, docs = "/root/testdata/sf0.001", {}, None
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows["input"] = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, d).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        rows[name] = docs.collect()
    # quality: scores by plain sums
    model = quality.train(spark.read.parquet(f"{d}/documents.parquet"), quality.rated(spark.read.parquet(f"{d}/labels.parquet")), quality.GRADES)
    chance = lambda t: 1 / (1 + np.exp(-(sum(float(model.weights[b]) for b in plain_features(t)) - model.thresholds[-1])))
    assert {r.doc_id for r in rows["quality"]} == {r.doc_id for r in rows["input"] if chance(r.text) >= quality.KEEP}
    # near_dedup: every pair's shingle sets
    assert {r.doc_id for r in rows["near_dedup"]} == kept_by_brute_force([(r.doc_id, r.text) for r in rows["quality"]])
    # secrets: no rule matches any more, and nothing else has changed
    before = {r.doc_id: r for r in rows["near_dedup"]}
    assert len(rows["secrets"]) == len(before)
    for r in rows["secrets"]:
        old = before[r.doc_id].text
        kept = re.escape(r.text).replace(re.escape("[SECRET]"), "(?s:.+)")
        assert re.fullmatch(kept, old) and r.n_chars == len(r.text) and not brute_base(r.text.replace("[SECRET]", " "))
        assert ("[SECRET]" in r.text) or r.text == old
    # mixing: targets, and copies of a document the floor of its source's rate or one more
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    sizes, copies = {}, {}
    for r in rows["secrets"]:
        sizes[r.source] = sizes.get(r.source, 0) + words(r.text)
    for r in rows["mixing"]:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    targets = brute_targets(sizes)
    for r in rows["secrets"]:
        assert copies.get(r.doc_id, 0) - int(targets[r.source] / sizes[r.source]) in (0, 1)
    # encoding: the library's ids of every row
    library, coded = Library.from_file(corpus_pipeline.TOKENIZER), {}
    for r in rows["encoding"]:
        coded.setdefault(r.doc_id, []).append(list(r.ids))
    for r in rows["secrets"]:
        ids = library.encode(r.text, add_special_tokens=False).ids
        assert coded.get(r.doc_id, []) == [ids] * copies.get(r.doc_id, 0)
    assert sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, d).collect()) == sorted((r.doc_id, r.n_tokens) for r in rows["encoding"])


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    extra = ["keep", "expected_grade", "tail_probability", "spans", "copies", "row", "_id", "fp", "node", "bands", "draw", "ids"]
    docs = spark.createDataFrame([(k, f"words of text {k} token=abcdef{k}", "en", "s", 20) for k in range(9)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit(f"own {c}") for c in extra})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns[5:] == extra, name
        assert {tuple(r[5:]) for r in docs.collect()} == {tuple(f"own {c}" for c in extra)}, name


def test_pipeline_of_awkward_and_no_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "some words here", "en", "s", 15), (3, "some words here", "en", "s", 15), (None, "no id at all", None, None, 12)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert {r.doc_id for r in docs.collect()} <= {1, 2, 3, None}
    docs = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.count() == 0
