"""Secret scans: a random forest over token shape, dictionary, path and neighbouring words."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphgrove.llm.common import materialise, schema_of
from glyphgrove.runtime import scratch_path

#: A candidate is a run of so many characters of keys and encodings.
SHORTEST = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_\-]{%d,}={0,2}" % SHORTEST)
#: At most so many labelled findings are learned from.
MAX_FINDINGS = 20_000
#: A word is in the dictionary if at least so many documents of a language and at least this share of them hold
#: it; so a language has at most (mean distinct words of its documents) / share words.
WORD_DOCS, WORD_SHARE = 2, 0.001
TREES, DEPTH, SEED, ACCEPT = 30, 8, 7, 0.5
#: Paths that speak against a live secret, and words around a value that speak for one. Fixed values.
SAMPLE_PATH = ("test", "example", "sample", "mock", "fixture", "doc", "demo")
KEY_WORD = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "access_key", "private_key", "auth")

#: A value of any signs assigned to a key word, from so many characters on, is a candidate as well.
SHORTEST_ASSIGNED = 6
VALUE = re.compile(
    r"\s*(?:\"([^\"\n]{%d,})\"|'([^'\n]{%d,})'|[\"']?([^\s\"']\S{%d,}))" % (*[SHORTEST_ASSIGNED] * 2, SHORTEST_ASSIGNED - 1))
SIGN = re.compile("[:=]")

FEATURES = (
    "length", "digits", "upper", "lower", "signs", "changes", "longest_run", "entropy", "hex",
    "transition", "dictionary", "slashes", "enclosed_extra", "sample_path", "path_depth",
    "before", "after",
)


@dataclass(frozen=True)
class Corpus:
    """What the features need from the collection: its words and its letter transitions."""

    words: frozenset[str]
    transitions: np.ndarray
    heads: frozenset[str]

    def transition(self, value: str) -> float:
        codes = _codes(value)
        return float(self.transitions[codes[:-1], codes[1:]].mean()) if len(codes) > 1 else 0.0

    def covered(self, value: str) -> float:
        """Share of the characters that the longest dictionary words, from left to right, cover."""
        low, at, hit = value.lower(), 0, 0
        while at < len(low):
            # most places start no word: three letters tell
            for size in range(min(12, len(low) - at), 2, -1) if low[at : at + 3] in self.heads else ():
                if low[at : at + size] in self.words:
                    hit += size
                    at += size
                    break
            else:
                at += 1
        return hit / max(len(low), 1)


#: Letter words that may be in the dictionary: whole runs of a to z.
WORD = re.compile(r"(?<![a-z])[a-z]{3,12}(?![a-z])")

#: Letters without case 0-25, digits 26, everything else 27.
_CODES = np.full(128, 27)
_CODES[48:58] = 26
_CODES[65:91] = _CODES[97:123] = np.arange(26)


#: Digits 0, capitals 1, small letters 2, everything else 3.
_KINDS = np.full(128, 3)
_KINDS[48:58], _KINDS[65:91], _KINDS[97:123] = 0, 1, 2


def _points(text: str) -> np.ndarray:
    """Code points, those beyond ASCII as 127."""
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 127)


def _codes(text: str) -> np.ndarray:
    return _CODES[_points(text)]


def _pairs(text: str) -> np.ndarray:
    """How often each code follows each within the runs without white space of a text, as 784 numbers."""
    points = _points(text)
    codes = _CODES[points]
    solid = (points > 32) & (points != 127)
    both = solid[1:] & solid[:-1]
    return np.bincount((codes[:-1] * 28 + codes[1:])[both], minlength=784)


def corpus(docs: DataFrame, text: str = "text", lang: str = "lang", docs_least: int = WORD_DOCS,
           share: float = WORD_SHARE) -> Corpus:
    """The letter words (3 to 12 letters) that enough documents of a language hold, and how characters follow.

    Counted over all documents in Spark. 784 sums of transitions are collected, and the dictionary, whose size
    ``share`` bounds. Without the column ``lang`` all documents are of one language.
    """
    tongue = F.coalesce(F.col(lang).cast("string"), F.lit("")) if lang in docs.columns else F.lit("")
    schema = schema_of(("lang", T.StringType()), ("word", T.StringType()), ("pair", T.LongType()), ("times", T.LongType()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One scan of the texts: documents a word of a language is in, documents of a language, and pairs of characters."""
        total = np.zeros(784, np.int64)
        for batch in batches:
            held: dict[str, Counter] = {}
            for own, t in zip(batch.column("_lang").to_pylist(), batch.column("_text").to_pylist(), strict=True):
                total += _pairs(t)
                # "" counts the documents
                held.setdefault(own, Counter()).update({"", *WORD.findall(t.lower())})
            for own, words in held.items():
                n = len(words)
                yield pa.RecordBatch.from_arrays([
                    pa.array([own] * n, pa.string()), pa.array(list(words), pa.string()), pa.nulls(n, pa.int64()),
                    pa.array(list(words.values()), pa.int64())], names=schema.names)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([
            pa.nulls(len(met), pa.string()), pa.nulls(len(met), pa.string()), pa.array(met, pa.int64()),
            pa.array(total[met], pa.int64())], names=schema.names)

    scanned = docs.select(tongue.alias("_lang"), F.coalesce(F.col(text), F.lit("")).alias("_text")).mapInArrow(work, schema)
    counts = materialise(scanned.groupBy("lang", "word", "pair").agg(F.sum("times").alias("count")), "words")
    totals = counts.where("word = ''").select("lang", F.col("count").alias("total"))
    rows = counts.where("word <> ''").join(totals, "lang").where(
        (F.col("count") >= docs_least) & (F.col("count") >= share * F.col("total"))).select("word").distinct().collect()
    table = np.ones(784)
    for r in counts.where("pair is not null").select("pair", "count").collect():
        table[r["pair"]] += r["count"]
    table = table.reshape(28, 28)
    words = frozenset(r["word"] for r in rows)
    return Corpus(words, np.log(table / table.sum(axis=1, keepdims=True)), frozenset(w[:3] for w in words))


def label(value: str, before: str) -> tuple[int, bool] | None:
    """(1 or 0, whether the word before it decided) for a candidate whose nature is settled, else None.

    Known key formats and values assigned to a key word are secrets; plain words, numbers, dotted or
    hyphened words and UUIDs are not. A row whose label comes from the word before it is learned from without that
    word, so that the forest has to tell it by its other features.
    """
    assigned = re.search(r"([A-Za-z_\-]+)[\"']?\s*[:=]\s*[\"']?$", before)
    if re.fullmatch(r"AKIA[0-9A-Z]{16}", value) or re.match(r"(ghp|gho|xox[bp]|sk_live)_?", value):
        return 1, False
    if assigned and any(k in assigned[1].lower() for k in KEY_WORD) and re.search(r"\d", value):
        return 1, True
    if re.fullmatch(r"[A-Za-z]+([-_/][A-Za-z]+)*", value) or re.fullmatch(r"[\d\-]+", value):
        return 0, False
    if re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", value):
        return 0, False
    return None


def _word(text: str, last: bool) -> str:
    found = re.findall(r"[A-Za-z_]{2,}", text)
    return "" if not found else (found[-1] if last else found[0]).lower()


def _shape(value: str, enclosing: str, path: str, known: Corpus) -> list[float]:
    n = len(value)
    kinds = _KINDS[_points(value)]
    edges = np.concatenate([[0], np.flatnonzero(np.diff(kinds)) + 1, [n]])
    runs, longest = len(edges) - 1, int(np.diff(edges).max())
    share = (np.bincount(kinds, minlength=4) / n).tolist()
    counts = Counter(value).values()
    entropy = -sum(c / n * math.log2(c / n) for c in counts)
    low = path.lower()
    return [
        min(n, 256), *share, runs / n, longest / n, entropy,
        float(re.fullmatch(r"[0-9a-fA-F]+", value) is not None),
        known.transition(value), known.covered(value), value.count("/"), len(enclosing) - n,
        float(any(w in low for w in SAMPLE_PATH)), float(path.count("/")),
    ]


def _name_before(text: str, low: int, high: int) -> str:
    """The name in lower case that ends before ``high``, a quote and white space apart; none if there is no name."""
    i = high
    while i > low and text[i - 1].isspace():
        i -= 1
    if i > low and text[i - 1] in "\"'":
        i -= 1
    stop = i
    while i > low and (text[i - 1] in "_-" or text[i - 1].isascii() and text[i - 1].isalnum()):
        i -= 1
    return text[i:stop].lower()


def _spans(text: str) -> list[tuple[int, int]]:
    """Spans of the candidates in order; of overlapping ones the whole value assigned to a key word counts."""
    assigned, at, before = [], 0, 0
    low = text.lower()
    for sign in SIGN.finditer(text) if any(k in low for k in KEY_WORD) else ():
        i = sign.start()
        # the name before the sign, back to the sign before at most: every character is looked at once
        name = _name_before(text, before, i)
        before = i + 1
        if i < at or not any(k in name for k in KEY_WORD):
            continue
        m = VALUE.match(text, i + 1)
        if not m:
            continue
        k = next(i for i in (1, 2, 3) if m[i] is not None)
        a, b = m.span(k)
        if k == 3:
            b = a + max(len(m[k].rstrip("\"'`.,;:)]}>")), SHORTEST_ASSIGNED)
        assigned.append((a, b))
        at = b
    out, k = [], 0
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        while k < len(assigned) and assigned[k][1] <= a:
            out.append(assigned[k])
            k += 1
        if k < len(assigned) and assigned[k][0] < b:
            if assigned[k][0] <= a and b <= assigned[k][1]:
                continue   # within the value, which comes whole
            if a <= assigned[k][0] and assigned[k][1] <= b:
                k += 1     # the run is the longer one
            else:
                assigned[k] = (min(a, assigned[k][0]), max(b, assigned[k][1]))
                continue
        out.append((a, b))
    return sorted({*out, *assigned[k:]})


def _found(text: str, path: str, known: Corpus) -> Iterator[tuple[int, int, str, str, str, list[float]]]:
    """(start, stop, value, text before, word after, shape) of each candidate of a text."""
    for a, b in _spans(text):
        left = text[max(0, a - 48) : a]
        right = text[b : b + 32]
        enclosing = re.search(r"\S*$", left)[0] + text[a:b] + re.match(r"\S*", right)[0]
        yield a, b, text[a:b], left, _word(right, False), _shape(text[a:b], enclosing, path, known)


@dataclass(frozen=True)
class Forest:
    """Trees as flat arrays, evaluated many rows at once, and the log-odds of neighbouring words."""

    feature: list[np.ndarray]
    threshold: list[np.ndarray]
    left: list[np.ndarray]
    right: list[np.ndarray]
    share: list[np.ndarray]
    before: dict[str, float]
    after: dict[str, float]
    corpus: Corpus

    def rows(self, shapes: list[list[float]], before: list[str], after: list[str]) -> np.ndarray:
        """Feature rows; a neighbouring word that was never seen has log-odds 0."""
        return np.array([
            [*s, self.before.get(_word(b, True), 0.0), self.after.get(a, 0.0)]
            for s, b, a in zip(shapes, before, after, strict=True)
        ]).reshape(-1, len(FEATURES))

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for f, t, lo, hi, share in zip(self.feature, self.threshold, self.left, self.right, self.share, strict=True):
            node = np.zeros(len(x), np.int64)
            while True:
                inner = f[node] >= 0
                if not inner.any():
                    break
                i = np.flatnonzero(inner)
                down = x[i, f[node[i]]] <= t[node[i]]
                node[i] = np.where(down, lo[node[i]], hi[node[i]])
            total += share[node]
        return total / max(len(self.feature), 1)


def labelled_findings(
    docs: DataFrame, known: Corpus, id_column: str = "doc_id", text: str = "text", path: str = "source",
    limit: int = MAX_FINDINGS,
) -> DataFrame:
    """(before, after, shape, secret): candidates whose form settles what they are, distinct values once.

    Both classes are kept to about ``limit`` / 2 by a hash of the value; the same rows in every run.
    """
    schema = schema_of(
        ("value", T.StringType()), ("before", T.StringType()), ("after", T.StringType()),
        ("shape", T.ArrayType(T.DoubleType())), ("secret", T.IntegerType()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t, p in zip(batch.column("_text").to_pylist(), batch.column("_path").to_pylist(), strict=True):
                for _, _, value, left, right, shape in _found(t or "", p or "", known):
                    mark = label(value, left)
                    if mark is not None:
                        rows.append((value, "" if mark[1] else _word(left, True), right, shape, mark[0]))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, [
                    pa.string(), pa.string(), pa.string(), pa.list_(pa.float64()), pa.int32()], strict=True)],
                names=schema.names)

    narrow = docs.select(F.col(text).alias("_text"), F.col(path).cast("string").alias("_path"))
    every = narrow.mapInArrow(work, schema).groupBy("value", "secret").agg(
        F.min(F.struct("before", "after", "shape")).alias("f"))
    every = every.select(F.xxhash64("value").alias("h"), "value", "secret", "f.*")
    half = limit // 2
    secrets = every.where("secret = 1").orderBy("h", "value").limit(half)
    others = every.where("secret = 0").orderBy("h", "value").limit(half)
    return secrets.unionByName(others).drop("h", "value")


def _odds(words: list[str], marks: np.ndarray) -> dict[str, float]:
    """Smoothed log-odds of a word standing next to a secret rather than to another candidate."""
    good, bad = Counter(), Counter()
    for w, m in zip(words, marks, strict=True):
        if w:
            (good if m else bad)[w] += 1
    a, b = sum(good.values()) + 1, sum(bad.values()) + 1
    return {w: math.log((good[w] + 0.5) / a / ((bad[w] + 0.5) / b)) for w in {*good, *bad} if good[w] + bad[w] > 1}


def train(docs: DataFrame, findings: DataFrame | None = None, id_column: str = "doc_id", text: str = "text",
          path: str = "source", trees: int = TREES, depth: int = DEPTH) -> Forest:
    """Fit the forest on labelled findings, by default those of ``labelled_findings``.

    With findings of one class only, the forest is empty and takes nothing for a secret.
    """
    spark = docs.sparkSession
    known = corpus(docs, text)
    if findings is None:
        findings = labelled_findings(docs, known, id_column, text, path)
    table = findings.select("before", "after", "shape", "secret").toArrow()   # at most MAX_FINDINGS rows
    # in an order of their own, so that the same findings give the same forest
    rows = sorted(table.to_pylist(), key=repr)
    marks = np.array([r["secret"] for r in rows])
    if len(rows) == 0 or marks.min() == marks.max():
        return Forest([], [], [], [], [], {}, {}, known)
    before, after = [r["before"] for r in rows], [r["after"] for r in rows]
    model = Forest([], [], [], [], [], _odds(before, marks), _odds(after, marks), known)
    x = model.rows([r["shape"] for r in rows], before, after)
    # both classes weigh the same, however rare secrets are among the findings
    weight = len(marks) / (2.0 * np.bincount(marks, minlength=2))
    data = spark.createDataFrame(
        [(v.tolist(), float(m), float(weight[m])) for v, m in zip(x, marks, strict=True)],
        "x array<double>, y double, weight double",
    ).select(array_to_vector("x").alias("features"), F.col("y").alias("label"), "weight").repartition(1)
    fitted = RandomForestClassifier(
        weightCol="weight", numTrees=trees, maxDepth=depth, seed=SEED, featureSubsetStrategy="sqrt", subsamplingRate=1.0).fit(data)
    return _flatten(spark, fitted, model)


def _flatten(spark: SparkSession, fitted: RandomForestClassificationModel, model: Forest) -> Forest:
    """The trees as arrays, read from the saved model."""
    place = scratch_path(spark, "forest")
    fitted.write().save(place)
    nodes = spark.read.parquet(f"{place}/data").select("treeID", "nodeData.*").collect()
    out: list[list[np.ndarray]] = [[] for _ in range(5)]
    for tree in sorted({n["treeID"] for n in nodes}):
        own = sorted((n for n in nodes if n["treeID"] == tree), key=lambda n: n["id"])
        stats = [np.array(n["impurityStats"]) for n in own]
        leaf = [n["leftChild"] < 0 for n in own]
        out[0].append(np.array([-1 if e else n["split"]["featureIndex"] for n, e in zip(own, leaf, strict=True)]))
        out[1].append(np.array([0.0 if e else n["split"]["leftCategoriesOrThreshold"][0] for n, e in zip(own, leaf, strict=True)]))
        out[2].append(np.array([n["leftChild"] for n in own]))
        out[3].append(np.array([n["rightChild"] for n in own]))
        out[4].append(np.array([s[1] / s.sum() for s in stats]))
    return Forest(*out, model.before, model.after, model.corpus)


def findings(docs: DataFrame, model: Forest, id_column: str = "doc_id", text: str = "text",
             path: str = "source", accept: float = ACCEPT) -> DataFrame:
    """Return (doc_id, start, stop, probability, kind, sha256): a row for each secret the forest accepts.

    ``start`` and ``stop`` are code points of the text; ``kind`` is the key word before the value, or the
    value's form; the value itself is not repeated, only its digest. Null and empty texts have none; repeated
    rows give repeated findings. Extra columns are ignored. No shuffle: one pass over the whole texts.
    """
    schema = schema_of(
        ("doc_id", T.LongType()), ("start", T.LongType()), ("stop", T.LongType()),
        ("probability", T.DoubleType()), ("kind", T.StringType()), ("sha256", T.StringType()))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, t, spans in _accepted(batch, shared.value, accept):
                for a, b, p in spans:
                    word = next((k for k in KEY_WORD if k in t[max(0, a - 24) : a].lower()), "")
                    rows.append((name, a, b, p, word or _form(t[a:b]), hashlib.sha256(t[a:b].encode()).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=schema.names)

    narrow = docs.select(F.col(id_column).cast("long").alias("_id"), F.col(text).alias("_text"),
                         F.col(path).cast("string").alias("_path"))
    return narrow.mapInArrow(work, schema)


def _form(value: str) -> str:
    return "hex" if re.fullmatch("[0-9a-fA-F]+", value) else "key" if value.upper() == value else "mixed"


def _accepted(batch: pa.RecordBatch, model: Forest, accept: float) -> Iterator[tuple[int, str, list]]:
    """(id, text, [(start, stop, probability)]) for each row of a batch of _id, _text, _path."""
    texts = [t or "" for t in batch.column("_text").to_pylist()]
    paths = [p or "" for p in batch.column("_path").to_pylist()]
    seen = [list(_found(t, p, model.corpus)) for t, p in zip(texts, paths, strict=True)]
    flat = [f for own in seen for f in own]
    share = model.probability(model.rows([f[5] for f in flat], [f[3] for f in flat], [f[4] for f in flat]))
    at = 0
    for name, t, own in zip(batch.column("_id").to_pylist(), texts, seen, strict=True):
        p = share[at : at + len(own)]
        at += len(own)
        yield name, t, [(f[0], f[1], float(v)) for f, v in zip(own, p, strict=True) if v >= accept]


def redact(docs: DataFrame, model: Forest, text: str = "text", path: str = "source",
           n_chars: str | None = "n_chars", mark: str = "[SECRET]", accept: float = ACCEPT) -> DataFrame:
    """``docs`` with each accepted secret replaced by ``mark``; no row is dropped, null texts stay null.

    ``n_chars`` is set to the new length in changed rows, where the column exists; without the column ``path`` all paths
    are empty. Repeated rows and null ids are treated like others, other columns stay as they are, no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema
    length = n_chars if n_chars in schema.names else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = pa.RecordBatch.from_arrays(
                [pa.array(range(batch.num_rows)), batch.column(text),
                 batch.column(path).cast(pa.string()) if path in batch.schema.names else pa.nulls(batch.num_rows, pa.string())],
                names=["_id", "_text", "_path"])
            texts = batch.column(text).to_pylist()
            sizes = batch.column(length).to_pylist() if length else []
            for i, t, spans in _accepted(asked, shared.value, accept):
                for a, b, _ in reversed(spans):
                    t = t[:a] + mark + t[b:]
                if spans:
                    texts[i] = t
                    if length:
                        sizes[i] = len(t)
            changed = {text: pa.array(texts, pa.string())}
            if length:
                changed[length] = pa.array(sizes, batch.schema.field(length).type)
            yield pa.RecordBatch.from_arrays(
                [changed[n] if n in changed else batch.column(n) for n in schema.names], names=schema.names)

    return docs.mapInArrow(work, schema)
