"""License scans by a trained paragraph classifier, checked against templates.

Training (on the driver, in numpy): multinomial logistic regression over the presence of word
1- to 3-grams, with an L1 penalty that leaves the model sparse. Its examples are the licence
templates, whole and cut, alone and amid prose, and for the unknown class notices of licences that
are no class, look-alikes and prose: of SAMPLE_DOCS documents, chosen by a hash of the id, the first
SAMPLE_CHARS characters' first LINES_OF_EACH lines, LINE_CHARS characters of each at most. Calibration
is by FOLDS folds of whole templates: each fold's probabilities come from a model that saw none of
its templates, and one temperature is fitted to all of them. Predictions read whole texts.

Scanning is DataFrame expressions only. A document is cut into paragraphs: its lines, and
where blank lines set off several lines, those together. A fixed list of words is the gate: every
template holds one, and a paragraph without any is unknown without being scored. A paragraph that is
unknown with a probability over 1 - CONFIDENCE is unknown; else its families are those with a
probability of SECOND (a dual licence has two) that are confirmed: the paragraph holds SIMILAR of the
five-word shingles of one of the family's templates (a template of fewer words is one shingle of its own
length). The spellings licence and license are one word.

Everything about a document is computed in its row, so nothing is shuffled.

Defined cases: null and empty texts have no paragraphs and no licence. Repeated paragraphs
count once, repeated rows each. Of several confirmed families license is the most probable, then
the first by name, where those that only a template under five words confirms ('All rights
reserved' above a licence) come after the others; without any it is 'none'. An empty table gives no rows. Extra columns are
ignored.
"""

from __future__ import annotations

import json
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linequarry.llm.common import table, text_or_empty
from linequarry.llm.license_templates import GATE, LOOKALIKES, OTHERS, TEMPLATES

GRAMS, SHINGLE, SIMILAR, CONFIDENCE, SECOND, FOLDS = 3, 5, 0.8, 0.5, 0.05, 4
SAMPLE_DOCS, SAMPLE_CHARS, LINES_OF_EACH, LINE_CHARS = 300, 4000, 4, 600
UNKNOWN = "unknown"
NOT_WORD = r"[^a-z0-9.]+"


def words(text: str) -> list[str]:
    return [w for w in (x.strip(".") for x in re.split(NOT_WORD, text.lower().replace("licenc", "licens"))) if w]


def ngrams(w: list[str], n: int = GRAMS) -> set[str]:
    return {" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)}


def shingles(w: list[str]) -> list[str]:
    return sorted({" ".join(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))}) if w else []


def examples(prose: list[str], seed: int = 5) -> list[tuple[list[str], str, int]]:
    """(words, class, template or sentence) of training paragraphs; those from one template or sentence share its number."""
    r, out, number = random.Random(seed), [], 0
    prose = [p for p in map(words, prose) if p]
    filler = prose or [words(x) for x in LOOKALIKES]
    some = lambda: r.choice(filler)[: r.randint(1, 25)]
    for family, texts in [*sorted(TEMPLATES.items()), (UNKNOWN, OTHERS + LOOKALIKES)]:
        for t in texts:
            w = words(t)
            rows = [w] * 3 + [some() + w, w + some(), some() + w + some()]
            if len(w) > 12:
                rows += [w[: -r.randint(1, len(w) // 4)], w[r.randint(1, len(w) // 4) :]]
            out += [(x, family, number) for x in rows]
            number += 1
    return out + [(p, UNKNOWN, number + i) for i, p in enumerate(prose)]


def train(prose: list[str], penalty: float = 0.002, rounds: int = 250) -> dict:
    """The model: classes, features with their weights, biases and temperature."""
    data = examples(prose)
    counts = Counter(g for w, _, _ in data for g in ngrams(w))
    # Other words say nothing that the unknown class's bias doesn't.
    known = {g for texts in [*TEMPLATES.values(), OTHERS, LOOKALIKES] for t in texts for g in ngrams(words(t))}
    features = sorted(g for g, n in counts.items() if n > 2 and g in known)
    at = {g: i for i, g in enumerate(features)}
    classes = [*sorted(TEMPLATES), UNKNOWN]
    x, y = np.zeros((len(data), len(features))), np.zeros((len(data), len(classes)))
    for i, (w, c, _) in enumerate(data):
        x[i, [at[g] for g in ngrams(w) if g in at]] = 1
        y[i, classes.index(c)] = 1
    fold = np.array([k for _, _, k in data]) % FOLDS
    weight = 1 / y.sum(axis=0)[y.argmax(axis=1)]  # every class weighs the same
    weight *= len(data) / weight.sum()

    def probabilities(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def fitted(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        xs, ys, ws = x[rows], y[rows], weight[rows, None]
        w, b = np.zeros((x.shape[1], y.shape[1])), np.zeros(y.shape[1])
        ahead, t = w, 1.0
        step = 4 * len(xs) / max((ws * xs.sum(axis=1, keepdims=True)).sum(), 1)
        for _ in range(rounds):
            g = ws * (probabilities(xs @ ahead + b) - ys) / len(xs)
            fresh = ahead - step * (xs.T @ g)
            fresh = np.sign(fresh) * np.maximum(np.abs(fresh) - step * penalty / 10, 0)
            b = b - step * g.sum(axis=0)
            nxt = (1 + (1 + 4 * t * t) ** 0.5) / 2
            ahead, w, t = fresh + (t - 1) / nxt * (fresh - w), fresh, nxt
        return w, b

    held = np.zeros_like(y)
    for k in range(FOLDS):
        w, b = fitted(fold != k)
        held[fold == k] = x[fold == k] @ w + b
    loss = lambda t: -(weight * np.log(probabilities(held / t)[y > 0] + 1e-12)).sum()
    temperature = min((0.25 * 1.15**k for k in range(25)), key=loss)
    w, b = fitted(np.ones(len(data), bool))
    w = np.round(w, 4)
    used = np.flatnonzero(np.abs(w).max(axis=1) > 0)
    return {"classes": classes, "features": [features[i] for i in used], "weights": w[used].tolist(), "biases": np.round(b, 4).tolist(), "temperature": temperature}


def sample_prose(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> list[str]:
    """Lines of at most sample_docs documents, for the unknown class; those that mention licences are left out."""
    ids = [r[0] for r in docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(sample_docs).collect()]
    rows = docs.where(F.col("doc_id").isin(ids)).select("doc_id", F.slice(F.split(F.substring(text_or_empty(), 1, SAMPLE_CHARS), "\n"), 1, LINES_OF_EACH).alias("lines")).collect() if ids else []
    lines = [x[:LINE_CHARS] for r in sorted(rows, key=lambda r: (r.doc_id, r.lines))[:sample_docs] for x in r.lines]
    return [x for x in lines if not re.search(r"licen[cs]|copyright|rights|public domain|creative commons|\bgnu\b", x.lower())]


def fixed(value: object, kind: str) -> Column:
    """A constant, folded once by the optimiser."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def tokens(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.replace(F.lower(text), F.lit("licenc"), F.lit("licens")), NOT_WORD), lambda w: F.btrim(w, F.lit("."))), lambda w: w != "")


def joined(w: Column, k: int) -> Column:
    """The k-grams of an array of words."""
    grams = lambda: F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.array_join(F.slice(w, i, k), " "))
    return F.when(F.size(w) >= k, grams()).otherwise(F.array().cast("array<string>"))


def scanned(docs: DataFrame, model: dict, confidence: float = CONFIDENCE) -> DataFrame:
    """doc_id, license, confidence, similarity, families, unconfirmed, n_paragraphs: one row per row of docs."""
    n = len(model["classes"])
    gate, features = fixed(GATE, "array<string>"), fixed(model["features"], "array<string>")
    weights, biases = fixed(model["weights"], "array<array<double>>"), fixed(model["biases"], "array<double>")
    texts = [[words(t) for t in TEMPLATES[c]] for c in model["classes"][:-1]]
    templates = fixed([[shingles(w) for w in c] for c in texts], "array<array<array<string>>>")
    longer = fixed([[shingles(w) for w in c if len(w) >= SHINGLE] for c in texts], "array<array<array<string>>>")
    short = sorted({len(w) for c in texts for w in c if len(w) < SHINGLE})
    classes = fixed(model["classes"], "array<string>")
    has_word = lambda p: p.rlike(r"[^\x20\x09-\x0D]")
    lines = F.split(F.col("text"), "\n")
    sets = F.filter(F.split(F.col("text"), r"\n[\x20\x09\x0B-\x0D]*\n\s*"), lambda p: p.contains("\n"))
    gated = F.arrays_overlap(F.split(F.lower("text"), "[^a-z]+"), gate)
    df = docs.select("doc_id", text_or_empty().alias("text"))
    df = df.select("doc_id", F.size(F.filter(lines, has_word)).cast("long").alias("n_paragraphs"), F.when(gated, F.array_distinct(F.concat(lines, sets))).otherwise(F.array().cast("array<string>")).alias("paragraphs"))
    df = df.withColumn("words", F.filter(F.transform("paragraphs", tokens), lambda w: F.arrays_overlap(F.split(F.array_join(w, " "), "[^a-z]+"), gate))).drop("paragraphs")
    grams = lambda w: F.array_intersect(F.concat(w, *[joined(w, k) for k in range(2, GRAMS + 1)]), features)
    rows = lambda w: F.transform(grams(w), lambda g: F.element_at(weights, F.array_position(features, g).cast("int")))
    df = df.withColumn("found", F.transform("words", lambda w: F.struct(w.alias("w"), rows(w).alias("rows"))))
    # Sums over the few weights of a paragraph, class by class.
    one = lambda x, c: F.aggregate(x["rows"], F.element_at(biases, c), lambda a, r: a + F.element_at(r, c))
    logits = lambda x: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda c: one(x, c) / F.lit(float(model["temperature"])))
    df = df.withColumn("found", F.transform("found", lambda x: F.struct(x["w"].alias("w"), logits(x).alias("z"))))
    total = lambda x: F.aggregate(x["z"], F.lit(0.0), lambda a, v: a + F.exp(v - F.array_max(x["z"])))
    shares = lambda x: F.transform(x["z"], lambda v: F.exp(v - F.array_max(x["z"])) / total(x))
    df = df.withColumn("found", F.transform("found", lambda x: F.struct(x["w"].alias("w"), shares(x).alias("p"))))
    df = df.withColumn("found", F.filter("found", lambda x: F.element_at(x["p"], n) <= 1 - confidence))
    # A paragraph has an entry for each family that it may be of.
    maybe = lambda x: F.filter(F.transform(x["p"], lambda p, c: F.struct((c + 1).alias("c"), p.alias("p"))), lambda e: (e["c"] < n) & (e["p"] >= SECOND))
    close = lambda e, x, ts: F.coalesce(F.array_max(F.transform(F.element_at(ts, e["c"]), lambda t: F.size(F.array_intersect(t, x["s"])) / F.size(t))), F.lit(0.0))
    held = lambda w: F.concat(joined(w, SHINGLE), *[joined(w, k) for k in short])
    df = df.withColumn("found", F.transform("found", lambda x: F.struct(maybe(x).alias("of"), held(x["w"]).alias("s"))))
    entry = lambda e, x: F.struct((close(e, x, longer) < SIMILAR).alias("brief"), (-e["p"]).alias("doubt"), F.element_at(classes, e["c"]).alias("family"), close(e, x, templates).alias("similarity"))
    df = df.withColumn("found", F.flatten(F.transform("found", lambda x: F.transform(x["of"], lambda e: entry(e, x)))))
    df = df.withColumn("yes", F.array_sort(F.filter("found", lambda x: x["similarity"] >= SIMILAR)))
    names = lambda xs: F.array_sort(F.array_distinct(F.transform(xs, lambda x: x["family"])))
    best = F.get(F.col("yes"), F.lit(0))
    return df.select(
        "doc_id", F.coalesce(best["family"], F.lit("none")).alias("license"), (-best["doubt"]).alias("confidence"), best["similarity"].alias("similarity"),
        names(F.col("yes")).alias("families"), F.array_except(names(F.filter("found", lambda x: -x["doubt"] >= confidence)), names(F.col("yes"))).alias("unconfirmed"), "n_paragraphs",
    )


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scanned(docs, train(sample_prose(docs)))
