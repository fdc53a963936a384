"""Language identification by hierarchical discrimination.

A text's language family is predicted first; inside the family one-versus-one linear support vector machines tell
the related languages apart by vote. Features are hashed character n-grams of the letters of the whole text."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm.common import map_values, written
from webloom.session import ship_package

#: Hash buckets of the features.
BUCKETS = 1 << 13
#: Characters of a text hashed at once, so that the memory of a task is bounded; n-grams run on from piece to piece.
PIECE = 1 << 20

#: Families of related languages by ISO 639-1 code. A language not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "mk", "sr", "hr", "bs", "sl"),
    "baltic": ("lt", "lv"),
    "celtic": ("ga", "cy", "gd", "br"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "tk"),
    "indic": ("hi", "mr", "ne", "bn", "ur", "pa", "gu"),
    "semitic": ("ar", "he", "mt"),
    "sinitic": ("zh", "yue"),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}


def family_of(lang: str) -> str:
    return FAMILY_OF.get(lang.lower().replace("_", "-").split("-")[0], f"own:{lang}")


def features(text: str) -> np.ndarray | None:
    """Unit vector of square roots of n-gram counts (n from 1 to 3, words padded with a space); None without a letter.
    Characters that aren't letters part words and are not features."""
    counts = np.zeros(BUCKETS)
    letters, tail = False, np.empty(0, np.uint32)
    known = _letter_table()
    for at in range(-1, len(text) + PIECE, PIECE):  # a space before the text and one behind it
        piece = text[max(at, 0):at + PIECE].lower() if at < len(text) else ""
        codes = np.frombuffer(piece.encode("utf-32-le", "replace"), "<u4").astype(np.uint32)
        is_letter = known[codes]
        letters |= bool(is_letter.any())
        edge = np.array([32], np.uint32)
        codes = np.concatenate([tail, edge[:at < 0], np.where(is_letter, codes, 32).astype(np.uint32), edge[:at >= len(text)]])
        codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])[:len(codes)]]  # runs of others are one space
        one = codes * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ (codes[1:] + np.uint32(0x85EBCA6B))) * np.uint32(0xC2B2AE35)
        three = (two[:-1] ^ (codes[2:] + np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
        seen = len(tail)  # n-grams that end in the tail were counted with the piece before
        for n, h in enumerate((one, two, three)):
            counts += np.bincount((h[max(seen - n, 0):] >> np.uint32(15)) % BUCKETS, minlength=BUCKETS)
        tail = codes[-2:]
    if not letters:
        return None
    counts = np.sqrt(counts)
    return counts / np.linalg.norm(counts)


_TABLE: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """For each code point whether it is a letter (str.isalpha)."""
    if not _TABLE:
        _TABLE.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _TABLE[0]


Sparse = tuple[np.ndarray, np.ndarray]  # a row's columns with a value, and these values


def sparse(x: np.ndarray) -> Sparse:
    used = np.flatnonzero(x).astype(np.int32)
    return used, x[used]


def fit_svm(x: np.ndarray | list[Sparse], y: np.ndarray, c: float = 4.0, epochs: int = 30, width: int = BUCKETS) -> np.ndarray:
    """Linear SVM (squared hinge) by dual coordinate descent in a fixed order of examples; the last weight is the bias.
    Examples are rows of an array, or sparse rows of ``width`` columns; one at a time is spread out in double precision."""
    rows, width = ([sparse(r) for r in x], x.shape[1]) if isinstance(x, np.ndarray) else (x, width)
    row = np.zeros(width + 1)

    def spread(i: int) -> np.ndarray:
        row[:] = 0.0
        row[rows[i][0]] = rows[i][1]
        row[-1] = 1.0
        return row
    w, alpha = np.zeros(width + 1), np.zeros(len(rows))
    norm = np.array([(spread(i) * row).sum() for i in range(len(rows))]) + 0.5 / c
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            gradient = y[i] * (spread(i) @ w) - 1 + alpha[i] * 0.5 / c
            new = max(alpha[i] - gradient / norm[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * row
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


@dataclass
class Model:
    """Families in order, their languages, and linear separators: one-versus-rest of families, one-versus-one inside."""

    families: list[str]
    languages: dict[str, list[str]]
    family_weights: np.ndarray
    pair_weights: dict[tuple[str, str], np.ndarray]

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and a score from 0 to 1: the logistic of the family's margin times that of the narrowest duel
        that the language decides. ``und`` and 0 for a text that is null or has no letter, or without any language."""
        x = features(text) if text else None
        if x is None or not self.families:
            return "und", 0.0
        x = np.append(x, 1.0)
        margins = self.family_weights @ x
        best = int(np.argmax(margins))
        second = np.partition(margins, -2)[-2] if len(margins) > 1 else -1.0
        score = _logistic(margins[best] - second if len(margins) > 1 else 4.0)
        names = self.languages[self.families[best]]
        if len(names) == 1:
            return names[0], score
        votes, strength = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0)
        duels = {}
        for (a, b), w in self.pair_weights.items():
            if a in votes and b in votes:
                m = float(w @ x)
                duels[a, b] = m
                votes[a if m >= 0 else b] += 1
                strength[a] += m
                strength[b] -= m
        lang = max(names, key=lambda n: (votes[n], strength[n]))
        narrow = min(m if a == lang else -m for (a, b), m in duels.items() if lang in (a, b))
        return lang, score * _logistic(2 * narrow)


def _logistic(m: float) -> float:
    return float(1 / (1 + np.exp(-2 * np.clip(m, -20, 20))))


def _duels(langs: list[str]) -> tuple[list[str], dict[str, list[str]], list[tuple]]:
    """Families in order, their languages, and the separators to fit: ``("family", f, None)`` against the rest (one for
    two families, none for one), ``("pair", a, b)`` inside."""
    families = sorted({family_of(n) for n in langs})
    members = {f: [n for n in langs if family_of(n) == f] for f in families}
    rest = families if len(families) > 2 else families[:len(families) - 1]
    pairs = [("pair", a, b) for names in members.values() for a, b in itertools.combinations(names, 2)]
    return families, members, [("family", f, None) for f in rest] + pairs


def _fit(duel: tuple, y: np.ndarray, rows: list[Sparse]) -> np.ndarray:
    kind, a, b = duel
    if kind == "pair":
        both = np.flatnonzero((y == a) | (y == b))
        return fit_svm([rows[i] for i in both.tolist()], np.where(y[both] == a, 1.0, -1.0)).astype(np.float32)
    side = np.array([1.0 if family_of(n) == a else -1.0 for n in y])
    return fit_svm(rows, side).astype(np.float32)


def _model(families: list[str], members: dict[str, list[str]], duels: list[tuple], weights: list[np.ndarray]) -> Model:
    found = {(a, b): w for (kind, a, b), w in zip(duels, weights, strict=True)}
    rows = [found[f, None] if (f, None) in found else -found[families[0], None] if len(families) == 2 else np.zeros(BUCKETS + 1, np.float32)
            for f in families]
    return Model(families, members, np.array(rows, np.float32).reshape(-1, BUCKETS + 1), {k: w for k, w in found.items() if k[1] is not None})


def train(rows: list[tuple[str, np.ndarray]], spark: SparkSession | None = None) -> Model:
    """From (language, feature vector) rows, in their order. With a session, the separators are fitted by its tasks, a
    few each, from the broadcast sample; the result is the same. A task holds the sample's sparse rows and one of them spread out."""
    if not rows:
        return Model([], {}, np.zeros((0, BUCKETS + 1)), {})
    y = np.array([lang for lang, _ in rows])
    families, members, duels = _duels(sorted(set(y.tolist())))
    held = [sparse(f) for _, f in rows]
    if spark is None or len(duels) < 2:
        return _model(families, members, duels, [_fit(d, y, held) for d in duels])
    ship_package(spark)
    sample = spark.sparkContext.broadcast((y, held))

    def work(batches):
        y, held = sample.value
        for batch in batches:
            for at, *duel in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                w = _fit(tuple(duel), y, held)
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([w.tobytes()], pa.binary())], names=["at", "w"])
    # a separator is a task: there are as many as families and pairs of languages
    table = spark.createDataFrame([(i, *d) for i, d in enumerate(duels)], "at long, kind string, a string, b string")
    fitted = table.repartitionByRange(min(len(duels), 512), "at").mapInArrow(work, "at long, w binary").collect()
    weights = [np.frombuffer(r["w"], np.float32) for r in sorted(fitted, key=lambda r: r["at"])]
    return _model(families, members, duels, weights)


def training_rows(labelled: DataFrame, text: str = "text", lang: str = "lang", per_language: int = 300,
                  total: int = 6_400) -> list[tuple[str, np.ndarray]]:
    """The bounded training sample: of every language, the ``per_language`` different texts of least hash, or
    fewer where languages are so many that these were more than ``total`` in all (at least 5 of each). No language is left
    out. Features are counted over the whole texts inside the tasks; sparse vectors of up to BUCKETS entries reach the driver.
    Distinct hashes are ranked by language and a part of the hash first, so that one language is split over tasks.
    Null or letterless texts and null languages are left out; an empty table gives no rows."""
    rows = labelled.select(F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").alias("l"),
                           F.xxhash64(F.col(f"`{text}`")).alias("h")).where("t is not null and l is not null")
    names = rows.agg(F.count_distinct("l").alias("n")).first()["n"]
    most = max(min(per_language, total // max(names, 1)), min(5, per_language))
    split = F.row_number().over(Window.partitionBy("l", F.pmod("h", F.lit(64))).orderBy("h"))
    rank = F.row_number().over(Window.partitionBy("l").orderBy("h"))
    few = rows.select("l", "h").distinct().withColumn("r", split).where(F.col("r") <= most)
    picked = few.withColumn("r", rank).where(F.col("r") <= most).drop("r")
    picked = written(picked, "language-sample")  # at most the bound above
    texts = rows.join(F.broadcast(picked), ["l", "h"]).groupBy("l", "h").agg(F.min("t").alias("t"))
    out = T.StructType([T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("value", T.ArrayType(T.FloatType()))])

    def start():
        def work(values):
            made = [features(t) for t in values]
            used = [np.flatnonzero(f) if f is not None else np.empty(0, int) for f in made]
            return [[u.astype(np.int32) for u in used], [f[u].astype(np.float32) if f is not None else u.astype(np.float32) for f, u in zip(made, used, strict=True)]]
        return work
    found = []
    for r in sorted(map_values(texts, F.col("t"), out, start, ["l", "h"]).where(F.size("at") > 0).collect(), key=lambda r: (r.l, r.h)):
        x = np.zeros(BUCKETS, np.float32)
        x[r["at"]] = r["value"]
        found.append((r.l, x))
    return found


def identify(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` to every row of ``df`` from its whole text alone. The model (a vector of
    32 kB for every family, and for every pair of languages inside one) is broadcast: it grows with the languages, not the rows. Null or letterless texts, and any text under a model without
    languages, are ``und`` with score 0. Repeated rows stay; columns with an added name are replaced."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    out = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def start():
        m = shared.value

        def work(texts):
            made = [m.predict(t) for t in texts]
            return [[p for p, _ in made], [s for _, s in made]]
        return work
    return map_values(df, F.col(f"`{text}`"), out, start, df.columns if keep is None else keep)
