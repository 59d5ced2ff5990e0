"""Language ID and quality: held-out accuracy, odd inputs, and that answers aren't read."""

import math
import random
import zlib
from collections import Counter

import numpy as np

from folioforge.llm import langid, quality
from folioforge.llm.common import table

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    docs = table(spark, SF, "documents")
    got = langid.predict(spark, docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 150 and np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_odd_inputs(spark, odd_docs, no_docs):
    model = langid.fit(odd_docs)
    got = langid.predict(spark, odd_docs, model).collect()
    assert len(got) == 6 and all(r.lang_pred in ("und", "en", "fr") for r in got)
    assert [r.lang_pred for r in got if r.doc_id == 8] == ["und"]
    assert langid.predict(spark, odd_docs, langid.fit(no_docs)).where("lang_pred != 'und'").count() == 0
    assert langid.predict(spark, no_docs, model).count() == 0


def test_codewords_are_far_apart():
    for k in (2, 3, 5, 7, 12, 40):
        m = langid.code(k)
        least = min((m[i] != m[j]).sum() for i in range(k) for j in range(i))
        assert least >= (m.shape[1] // 2 if k <= 7 else 10)


def test_quality_held_out(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = quality.score(spark, docs, labels)
    assert got.count() == docs.count()
    held = got.where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in held)


def test_quality_odd_inputs(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(7, 1), (7, None), (8, 0), (9, 1), (None, 0), (99, 5)], "doc_id long, quality int")
    assert quality.score(spark, odd_docs, labels).count() == 6
    assert {r.score for r in quality.score(spark, odd_docs, labels.where("quality > 7")).collect()} == {0.5}
    assert quality.score(spark, no_docs, labels).count() == 0


def test_pool_is_monotone():
    got = quality.pool(np.array([0.1, 0.5, 0.3, 0.2, 0.9, 0.8]), np.array([1, 1, 1, 3, 1, 1.0]))
    assert (np.diff(got) >= -1e-12).all() and abs(got[1:4].mean() - (0.5 + 0.3 + 0.6) / 5) < 1e-9


def language_texts():
    rnd, out = random.Random(2), []
    parts = {"aa": "bado kiru lem tas", "bb": "schön über öl zug", "cc": "ñandú qué así los"}
    for i in range(90):
        lang = list(parts)[i % 3]
        out.append((i, " ".join(rnd.choice(parts[lang].split()) + rnd.choice(["", "s", "en"]) for _ in range(rnd.randint(3, 30))), None if i % 11 == 0 else lang))
    return [*out, (200, "", "aa"), (201, "123 !!", "bb"), (202, None, "cc")]


def plain_features(text):
    """Square roots of the shares of hashed byte pairs and triples, one by one."""
    raw = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in (text or "").encode()]
    counts = Counter()
    for n, mult in ((2, 0x9E3779B1), (3, 0x85EBCA6B)):
        for i in range(len(raw) - n + 1):
            counts[int.from_bytes(bytes(raw[i : i + n]), "big") * mult % 2**32 >> 20] += 1
    x = np.zeros(langid.BUCKETS)
    if len(raw) > 2:
        for k, v in counts.items():
            x[k] = math.sqrt(v / sum(counts.values()))
    return x


def test_language_model_is_a_plain_refit(spark):
    """The same equations, bit by bit, in double precision."""
    rows = language_texts()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r.doc_id: r for r in langid.predict(spark, df, langid.fit(df)).collect()}
    known = [(t, lang) for i, t, lang in rows if lang and t is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    names = sorted({lang for _, lang in known})
    words = langid.code(len(names))
    x = np.array([plain_features(t) for t, _ in known]).astype(np.float16).astype(float)
    weights, sure = [], []
    for bit in range(words.shape[1]):
        y = np.array([words[names.index(lang), bit] for _, lang in known], float)
        w = v = np.zeros(langid.BUCKETS + 1)
        one = np.hstack([x, np.ones((len(x), 1))])
        for t in range(150):
            slope = -(one.T @ (y / (1 + np.exp(y * (one @ v))))) / len(y) + 1e-5 * v
            step = v - 2.0 * slope
            v, w = step + t / (t + 3) * (step - w), step
        weights.append(w)
        sure.append(max((((one @ w) * y) > 0).mean() - 0.5, 0.01))
    for i, t, _ in rows:
        if not t or not any(c.isalpha() for c in t):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        f = [4 * (plain_features(t) @ w[:-1] + w[-1]) for w in weights]
        loss = [sum(a * math.log1p(math.exp(-m * z)) for a, m, z in zip(sure, code, f, strict=True)) / sum(sure) for code in words]
        p = np.exp([-4 * (x - min(loss)) for x in loss])
        p /= p.sum()
        assert got[i].lang_pred == names[int(p.argmax())] and abs(got[i].score - p.max()) < 5e-3
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)


def test_quality_statistics_are_plain_ones():
    texts = ["One two two.\nThree!  Fourteenletters15x", "a", "x y\nx y\nx y", "ÄÖ 12 #!"]
    raw = [t.encode() for t in texts]
    got = quality.statistics(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for row, t, b in zip(got, texts, raw, strict=True):
        w = [x.encode() for x in t.split()]
        lines = [x for x in t.split("\n") if x]
        threes = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        want = {0: math.log1p(len(b)), 1: math.log1p(len(w)), 2: math.log1p(len(lines)), 3: np.mean([len(x) for x in w]), 4: np.std([len(x) for x in w]), 6: len(set(w)) / len(w), 7: max(Counter(w).values()) / len(w), 8: len(set(threes)) / max(len(threes), 1),
                10: len(set(lines)) / len(lines), 11: sum(a == c for a, c in zip(w, w[1:], strict=False)) / len(w), 12: sum(len(x) <= 3 for x in w) / len(w), 13: sum(len(x) >= 15 for x in w) / len(w), 14: sum(x[:1].isupper() and x[:1].isascii() for x in w) / len(w)}
        for k, v in want.items():
            assert abs(row[k] - v) < 1e-5, (t, k)


def test_quality_is_a_plain_refit(spark, docs_rows):
    """Ridge by least squares over all rows at once, then bins and pooled neighbours."""
    rnd = random.Random(9)
    rows = [(i, r[1]) for i, r in enumerate(docs_rows)] + [(1000 + i, "good text " * 9 + f"w{i}") for i in range(60)] + [(2000 + i, "!! ## " * rnd.randint(5, 40)) for i in range(60)]
    marks = [(i, int(i < 2000) if i >= 1000 else rnd.randrange(2)) for i, _ in rows if i % 3]
    got = {r.doc_id: r for r in quality.score(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(marks, "doc_id long, quality int")).collect()}
    raw = [(t or "").encode() for _, t in rows]
    x = np.vstack([quality.statistics(np.frombuffer(b, np.uint8), np.array([0, len(b)])) for b in raw]).astype(float)
    label, held = dict(marks), [zlib.crc32(str(i).encode()) % 4 == 2 for i, _ in rows]
    known = [k for k, (i, _) in enumerate(rows) if i in label and not held[k]]
    tunes = {r.doc_id for r in spark.createDataFrame([(rows[k][0],) for k in known], "doc_id long").where("pmod(xxhash64(doc_id), 5) = 0").collect()}
    mean, spread = x[known].mean(0), x[known].std(0)
    rng = np.random.default_rng(7)
    direction = rng.normal(size=(quality.WIDTH, quality.WAVES)) * np.repeat([0.35, 1.0], quality.WAVES // 2) / np.sqrt(quality.WIDTH)
    shift = rng.uniform(0, 2 * np.pi, quality.WAVES)
    z = np.clip((x - mean) / np.where(spread > 1e-9, spread, 1), -8, 8)
    z = np.hstack([np.cos(z @ direction + shift) * np.sqrt(2 / quality.WAVES), z / 10, np.ones((len(z), 1))])
    y = np.array([label.get(i, 0) for i, _ in rows], float)
    fit, tune = [k for k in known if rows[k][0] not in tunes], [k for k in known if rows[k][0] in tunes]
    penalty = np.sqrt(1e-3 * len(fit) / 10) * np.eye(z.shape[1])
    beta = np.linalg.lstsq(np.vstack([z[fit], penalty]), np.concatenate([y[fit], np.zeros(z.shape[1])]), rcond=None)[0]
    guess = np.clip(z @ beta, -0.5, 1.5)
    bins = {}
    for k in tune:
        bins.setdefault(min(int((guess[k] + 0.5) / 2 * quality.BINS), quality.BINS - 1), []).append(y[k])
    full = sorted(bins)
    prior = quality.PRIOR * y[known].mean()
    levels = [[(sum(bins[b]) + prior) / (len(bins[b]) + quality.PRIOR), len(bins[b]) + quality.PRIOR, [b]] for b in full]
    while any(a[0] >= b[0] for a, b in zip(levels, levels[1:], strict=False)):
        k = next(k for k in range(len(levels) - 1) if levels[k][0] >= levels[k + 1][0])
        (v, a, s), (w, b, t) = levels[k : k + 2]
        levels[k : k + 2] = [[(v * a + w * b) / (a + b), a + b, s + t]]
    level = [v for v, _, of in levels for _ in of]
    want = np.interp(guess, [(b + 0.5) / quality.BINS * 2 - 0.5 for b in full], level)
    off = [abs(got[i].score - want[k]) for k, (i, _) in enumerate(rows)]
    assert max(off) < 1e-3 and np.mean(off) < 1e-5
    assert all(r.predicted == (r.score >= 0.7) for r in got.values())


def test_one_id_many_times_is_one_label(spark):
    """Rows that repeat an id and text are one; other texts of the id are others, up to the bound."""
    base = [(i, f"{w} {w}ing {w}ed the text number {i}", lang) for i in range(60) for w, lang in (("walk", "en"), ("geh", "de"))]
    rows = [(r[0] * 4 + k, r[1], r[2]) for k, r in enumerate(base[:2])] + [(5, t, lang) for _, t, lang in base for _ in range(10)] + [(9, None, "en")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, per_language=20)
    assert model.languages == ["de", "en"]
    told = langid.predict(spark, df, model).where("lang_pred <> 'und'").collect()
    assert len(told) == len(rows) - 50
