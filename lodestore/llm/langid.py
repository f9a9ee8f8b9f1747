"""Language identification with averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its subwords (character pairs and triples of its words, hashed to
buckets); a linear layer and a softmax follow.  Both are trained by stochastic gradient descent in numpy on a
bounded sample of labelled documents, and on texts of no language: the sample with its letters shuffled, and
random letters of several scripts.  Those are a class of their own, so that a text of unknown subwords does not
have to belong to one of the languages.

A temperature and a threshold are then fitted on whole documents of the sample that training does not see.
The score is the probability of the best language.  A document is rejected if the probability that it is of any
of the languages is below one half, or below the REJECT quantile of labelled documents where that is lower; one
that mixes two known languages is not.  For this, a text counts as PRIOR subwords of an average labelled document
besides its own, so that a few odd words alone do not make a text one of no language.

As the model is linear up to the softmax, a trained model is applied as one table of bucket scores.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.llm.common import free_names, read_documents

BUCKETS = 1 << 15
DIM = 16
#: The most labelled documents of one language that a model is fitted on, and of all.  They come to the driver as
#: counts of their buckets, so a long text takes no more room than BUCKETS numbers.
PER_LANGUAGE = 600
SAMPLE = 6_000
#: Languages that are learned: the most frequent so many.
LANGUAGES = 1_000
EPOCHS = 4
#: Share of the documents of known languages that rejection may cost at most.
REJECT = 0.002
#: A document that is less likely than this of any known language is rejected.
SURE = 0.5
#: Subwords of an average document that a text is given when it is judged whether it is of any language.
PRIOR = 60
#: First and last code points of scripts that texts of no language are made of.
SCRIPTS = ((0x61, 0x7A), (0x61, 0x7A), (0x61, 0x7A), (0xDF, 0x17F), (0x3B1, 0x3C9), (0x430, 0x44F), (0x5D0, 0x5EA), (0x627, 0x64A), (0x905, 0x939), (0x3041, 0x3096), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))
UNKNOWN = "und"

#: A-Z to a-z, as bytes; all other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Letters, for the subwords: ASCII letters and every byte of a multi-byte character.
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def subwords(text: bytes) -> np.ndarray:
    """Buckets of the byte pairs and triples of the words of a text, a mark before and after each word."""
    buf = np.frombuffer(text, np.uint8)
    if not len(buf):
        return np.zeros(0, np.int64)
    c = np.where(LETTER[buf], LOWER[buf], 0)
    c = np.concatenate(([0], c, [0, 0])).astype(np.uint32)
    a, b, d = c[:-2], c[1:-1], c[2:]
    two = (a << 8 | b)[(a != 0) | (b != 0)]
    three = (a << 16 | b << 8 | d)[b != 0]
    h = np.concatenate((two | np.uint32(1 << 24), three)) * np.uint32(0x9E3779B1)
    return ((h ^ (h >> np.uint32(15))) % np.uint32(BUCKETS)).astype(np.int64)


Counts = tuple[np.ndarray, np.ndarray]


def counted(text: bytes) -> Counts:
    """Distinct buckets of a text and how often each occurs, in as few bytes as hold them."""
    n = np.zeros(BUCKETS, np.int64)
    for i in range(0, len(text), 1 << 20):
        n += np.bincount(subwords(text[i : i + (1 << 20)]), minlength=BUCKETS)
    ids = np.flatnonzero(n)
    return ids.astype(np.uint16), n[ids].astype(np.uint32)


def shuffled(text: str) -> bytes:
    """The text with its letters in another order, the same for equal texts."""
    raw = text.encode()
    points = np.array(list(map(ord, text)), np.uint32)
    letters = np.flatnonzero([c.isalpha() for c in text])
    points[letters] = points[np.random.default_rng(zlib.crc32(raw)).permutation(letters)]
    return points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")


def random_text(r: np.random.Generator) -> bytes:
    """Words of random letters of one script."""
    low, high = SCRIPTS[r.integers(len(SCRIPTS))]
    return " ".join("".join(map(chr, r.integers(low, high + 1, r.integers(1, 11)))) for _ in range(r.integers(2, 120))).encode()


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class Model:
    """Bucket scores of the languages and, last, of no language; temperature and rejection threshold."""

    def __init__(self, table: np.ndarray, bias: np.ndarray, langs: list[str], temperature: float = 1.0, threshold: float = 0.0):
        self.table, self.bias, self.langs, self.temperature, self.threshold = table, bias, langs, temperature, threshold
        #: Mean logits of labelled documents.
        self.usual = np.zeros(len(bias))

    def logits(self, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        return n @ self.table[ids] / max(int(n.sum()), 1) + self.bias

    def probabilities(self, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self._softmax(self.logits(ids, n))

    def _softmax(self, z: np.ndarray) -> np.ndarray:
        p = np.exp((z - z.max()) / self.temperature)
        return p / p.sum()

    def known(self, logits: np.ndarray, n: int) -> float:
        """The probability that a text of n subwords is of any language."""
        return 1 - float(self._softmax((n * logits + PRIOR * self.usual) / (n + PRIOR))[-1])

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, probability, and whether the prediction is rejected."""
        if not self.langs or not text or not has_letter(text):
            return UNKNOWN, 0.0, True
        ids, n = counted(text.encode("utf-8", "surrogatepass"))
        z = self.logits(ids, n)
        p = self._softmax(z)
        k = int(p[:-1].argmax())
        return self.langs[k], float(p[k]), self.known(z, int(n.sum())) < self.threshold


def train(texts: list[str], labels: list[str], seed: int = 11) -> Model:
    """Fit a model on texts and their labels."""
    return train_counts([counted(t.encode()) for t in texts], labels, [counted(shuffled(t)) for t in texts], seed)


def train_counts(rows: list[Counts], labels: list[str], junk: list[Counts], seed: int = 11) -> Model:
    """Fit a model on counts; every fifth text calibrates it.  No examples give a model that knows no language."""
    langs = sorted(set(labels))
    if not langs:
        return Model(np.zeros((BUCKETS, 1)), np.zeros(1), [])
    r = np.random.default_rng(seed)
    y = np.array([*map(langs.index, labels), *[len(langs)] * len(junk)])
    held = np.arange(len(y)) % 5 == 4
    rows = [*rows, *junk]
    some = [counted(random_text(r)) for _ in range(len(rows) // 8 + 4)]
    held, y, rows = np.append(held, np.zeros(len(some), bool)), np.append(y, np.full(len(some), len(langs))), [*rows, *some]
    full = np.array([len(ids) > 0 for ids, _ in rows])
    use = np.flatnonzero(~held & full)
    e = r.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    w, b = r.normal(0, 0.1, (DIM, len(langs) + 1)), np.zeros(len(langs) + 1)
    rows = [(ids.astype(np.int64), n) for ids, n in rows]
    shares = [(n / max(n.sum(), 1)).astype(np.float32) for _, n in rows]
    steps, done = EPOCHS * max(len(use), 1), 0
    for _ in range(EPOCHS):
        for k in r.permutation(use):
            rate = 2.0 * (1 - done / steps) + 0.01
            ids, share = rows[k][0], shares[k]
            mine = e[ids]
            h = share @ mine
            z = h @ w + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[k]] -= 1
            back = w @ p
            w -= rate * 0.1 * np.outer(h, p)
            b -= rate * 0.01 * p
            mine -= np.multiply.outer(share, (rate * 5 * back).astype(np.float32))
            e[ids] = mine
            done += 1
    model = Model(e.astype(np.float64) @ w, b, langs)
    check = np.flatnonzero(held & full)
    return calibrated(model, [rows[k] for k in check], y[check]) if len(check) else model


def calibrated(model: Model, rows: list[Counts], want: np.ndarray) -> Model:
    """The model with the temperature and the threshold that fit these documents.

    The loss gives each wrong class a share of 1 / (documents + 2), as if one document more of each kind had been
    seen, so that a best temperature exists even if every prediction is right.
    """
    z = np.array([model.logits(*row) for row in rows])
    share = 1 / (len(rows) + 2)
    goal = np.full(z.shape, share / max(z.shape[1] - 1, 1))
    goal[np.arange(len(z)), want] = 1 - share

    def loss(log_t: float) -> float:
        q = z / 2.0**log_t
        q = q - q.max(axis=1, keepdims=True)
        return float((np.log(np.exp(q).sum(axis=1)) - (q * goal).sum(axis=1)).mean())

    low, high = -16.0, 10.0
    for _ in range(60):  # the loss has one valley
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    model.temperature = 2.0 ** ((low + high) / 2)
    known = np.flatnonzero(want < len(model.langs))
    model.usual = z[known].mean(axis=0) if len(known) else model.usual
    some = np.sort([model.known(z[k], int(rows[k][1].sum())) for k in known])
    model.threshold = min(SURE, float(some[int(REJECT * len(some))])) if len(some) else SURE
    return model


def is_held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, sample: int = SAMPLE, languages: int = LANGUAGES) -> Model:
    """Train on labelled documents that are not held out.

    A sample by hash, of at most about per_language documents of each of the most frequent `languages`, and
    sample * 5 / 4 in all; texts are counted, and shuffled for texts of no language, where they are read.
    """
    labelled = docs.where(~is_held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    quota = min(per_language, max(1, sample // max(len(counts), 1)))
    # a threshold on the hash that leaves about `quota` of each language, then an exact limit in all
    spread = {r["lang"]: min(1.0, quota / r["count"]) for r in counts}
    share = F.create_map(*[F.lit(v) for kv in spread.items() for v in kv])[F.col("lang")] if spread else F.lit(0.0)
    at = F.xxhash64(F.lit("langid"), "doc_id")
    low = F.pmod(at, F.lit(1 << 30)) / float(1 << 30)

    def f(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            both = [[counted(t.encode("utf-8", "surrogatepass")) for t in texts], [counted(shuffled(t)) for t in texts]]
            cells = [pa.array([x[k].tobytes() for x in rows], pa.binary()) for rows in both for k in (0, 1)]
            yield pa.record_batch([b.column("at"), b.column("doc_id"), b.column("lang"), *cells], names=["at", "doc_id", "lang", "ids", "n", "junk_ids", "junk_n"])

    chosen = labelled.where(low < share).select(at.alias("at"), F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    found = chosen.mapInArrow(f, "at long, doc_id long, lang string, ids binary, n binary, junk_ids binary, junk_n binary")
    rows = found.orderBy("at", "doc_id", "ids").limit(sample + sample // 4).drop("at", "doc_id").collect()
    read = lambda r, a, b: (np.frombuffer(r[a], np.uint16), np.frombuffer(r[b], np.uint32))
    return train_counts([read(r, "ids", "n") for r in rows], [r["lang"] for r in rows], [read(r, "junk_ids", "junk_n") for r in rows])


FOUND = ("held_out", "lang_pred", "score", "rejected")


def annotate(docs: DataFrame, model: Model | None = None) -> tuple[DataFrame, list[str]]:
    """All columns of docs and, under free names that are returned too, those of FOUND; rows are not moved or dropped."""
    model = fit(docs) if model is None else model
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most BUCKETS rows, whatever the input
    names = docs.columns
    *new, plain = free_names(names, *FOUND, "t")
    # a text column of another type is read as a string beside the original
    text = "text" if dict(docs.dtypes)["text"] == "string" else plain
    more = [F.col("text").cast("string").alias(plain)] if text == plain else []

    def f(batches):
        m = shared.value
        for b in batches:
            found = [m.predict(t.as_py()) for t in b.column(text)]
            cols = [pa.array([x[k] for x in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.record_batch([b.column(c) for c in names] + [b.column(new[0]), *cols], names=[*names, *new])

    rows = docs.select(*[F.col(f"`{c}`") for c in names], is_held_out().alias(new[0]), *more)
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return rows.mapInArrow(f, f"{schema}, {new[0]} boolean, {new[1]} string, {new[2]} double, {new[3]} boolean"), new


def known_language(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of docs whose prediction is not rejected, with their own columns.

    Null and letterless texts go; repeated rows and null doc_ids are judged row by row; an empty table stays empty.
    """
    rows, new = annotate(docs, model)
    return rows.where(~F.col(new[3])).drop(*new)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row of docs(doc_id, text, lang).

    A null text, or one without a letter, is `und` with score 0 and rejected; so is every text if there is no
    labelled document to learn from.  Rows without doc_id are not held out.  Repeated rows stay; other
    columns are ignored.  The score is the calibrated probability of lang_pred.
    """
    model = fit(docs) if model is None else model
    rows, new = annotate(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model)
    return rows.select("doc_id", *[F.col(c).alias(k) for c, k in zip(new, FOUND, strict=True)])


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_documents(spark, sf_dir))


QUERIES = {"op8_language_id": op8_language_id}
