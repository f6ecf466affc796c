"""Language identification by interpolated Kneser-Ney character models.

Letters are lower-cased and all else is a space, runs of which are one. For each language an ORDER-gram model is fitted with
Kneser-Ney counts and one discount for each order. The models of all languages are stored together: for each order a
sorted array of gram hashes with each language's log probability, and a sorted array of context hashes with the
log weight of the lower order, which unknown grams fall back to. A text's language is the one with the lowest cross-entropy a
character. It is marked as rejected if that is above what CALIBRATED of that language's calibration texts have.

Fitting uses a sample of the labelled rows: about TRAIN_ROWS rows of each language, drawn by a hash of the id, CALIBRATION of
them for the rejection bounds. The sample bounds the model, which is made on the driver. Every row is predicted from
its whole text.

Cases: texts that are null or have no letter are `und` with score 0; without labelled rows every text is; ties go to the first
language by name; repeated rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import lookup, small_batches

ORDER = 4
TRAIN_ROWS, CALIBRATION, CALIBRATED = 2000, 0.2, 0.995
#: So many characters at most count as independent evidence in the score.
EVIDENCE = 30
SLICE = 1 << 18
SPACE = 32
_A = np.uint64(0x9E3779B97F4A7C15)


def letter_table() -> np.ndarray:
    """For each character of the first plane its lower-case letter, or a space."""
    out = np.full(1 << 16, SPACE, np.uint32)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def slices(texts: list[str | None]):
    a = size = 0
    for b, t in enumerate(texts):
        size += len(t or "") + 1
        if size >= SLICE:
            yield a, [x or "" for x in texts[a : b + 1]]
            a, size = b + 1, 0
    if a < len(texts):
        yield a, [x or "" for x in texts[a:]]


def characters(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The normalised characters of some texts, each text ended by a space, and the text each is in."""
    codes = np.frombuffer(" ".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    of = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    chars = table[np.minimum(codes, 0xFFFF)]
    for c in np.unique(codes[codes > 0xFFFF]).tolist():
        chars[codes == c] = ord(chr(c).lower()) if chr(c).isalpha() else SPACE
    keep = chars != SPACE
    keep[:1] = True
    keep[1:] |= (chars[:-1] != SPACE) | (of[1:] != of[:-1])
    return chars[keep], of[keep]


def columns(chars: np.ndarray, of: np.ndarray) -> list[np.ndarray]:
    """Each character and the ORDER - 1 before it, spaces before the text's first."""
    out = [chars.astype(np.uint64)]
    for k in range(1, ORDER):
        c = np.full(len(chars), SPACE, np.uint64)
        same = of[k:] == of[:-k]
        c[k:][same] = out[0][:-k][same]
        out.append(c)
    return out


def hashes(columns: list[np.ndarray]) -> np.ndarray:
    """A hash of grams; columns: the last character first."""
    h = np.zeros(len(columns[0]), np.uint64)
    with np.errstate(over="ignore"):
        for c in reversed(columns):
            h = h * _A + c + np.uint64(1)
    return h


def find(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each hash stands in a sorted array, and whether it does."""
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return at, keys[at] == h


class Model:
    """Kneser-Ney models of all languages. grams: for each language (characters (n, ORDER), the first first; counts)."""

    def __init__(self, grams: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.languages = sorted(grams)
        size = len(self.languages)
        tables = [self._orders(*grams[x]) for x in self.languages]
        self.orders = []
        lower = None
        for n in range(ORDER):
            own = [t[n] for t in tables]
            rows = np.unique(np.concatenate([g for g, _ in own]), axis=0)
            cols = [rows[:, -1 - i].astype(np.uint64) for i in range(n + 1)]
            keys, contexts = hashes(cols), hashes(cols[1:]) if n else np.zeros(len(rows), np.uint64)
            context_keys = np.unique(contexts)
            p, weight = np.zeros((len(rows), size)), np.ones((len(context_keys), size))
            for k, (g, c) in enumerate(own):
                h = hashes([g[:, -1 - i].astype(np.uint64) for i in range(n + 1)])
                ctx = hashes([g[:, -1 - i].astype(np.uint64) for i in range(1, n + 1)]) if n else np.zeros(len(g), np.uint64)
                at = np.searchsorted(context_keys, ctx)
                total, kinds = np.bincount(at, c, len(context_keys)), np.bincount(at, minlength=len(context_keys))
                once, twice = (c == 1).sum(), (c == 2).sum()
                d = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
                seen = total > 0
                weight[seen, k] = (d * kinds[seen] / total[seen]) if n else max(1e-4, d * len(g) / total[0])
                order = np.argsort(h)
                place, known = find(h[order], keys)
                count = np.where(known, c[order][place], 0)
                base = 1.0 / (len(rows) + 1) if lower is None else np.exp(lower[k_suffix(cols, self.orders[-1][0]), k])
                in_context = np.searchsorted(context_keys, contexts)
                t = total[in_context]
                p[:, k] = np.where(t > 0, np.maximum(count - d, 0) / np.maximum(t, 1), 0) + weight[in_context, k] * base
            order = np.argsort(keys)
            lower = np.log(p)[order]
            self.orders.append((keys[order], lower.astype(np.float32), context_keys, np.log(weight).astype(np.float32)))
        self.unknown = np.float32(np.log(1.0 / (len(self.orders[0][0]) + 1)))

    @staticmethod
    def _orders(g: np.ndarray, c: np.ndarray):
        """(grams, Kneser-Ney counts) from order 1 up: below the highest, how many characters a gram follows."""
        out = [(g, c.astype(np.float64))]
        for n in range(ORDER - 1, 0, -1):
            g, c = np.unique(out[-1][0][:, 1:], axis=0, return_counts=True)
            out.append((g, c.astype(np.float64)))
        return out[::-1]

    def log_p(self, columns: list[np.ndarray]) -> np.ndarray:
        """Log probability of each character in each language."""
        out = np.zeros((len(columns[0]), len(self.languages)), np.float32)
        todo = np.arange(len(columns[0]))
        for n in range(ORDER - 1, -1, -1):
            cols = [c[todo] for c in columns[: n + 1]]
            keys, values, context_keys, weights = self.orders[n]
            at, known = find(keys, hashes(cols))
            out[todo[known]] += values[at[known]]
            todo = todo[~known]
            if not len(todo):
                return out
            ctx, there = find(context_keys, hashes([c[~known] for c in cols[1:]]) if n else np.zeros(len(todo), np.uint64))
            out[todo[there]] += weights[ctx[there]]
        out[todo] += self.unknown
        return out

    def entropies(self, texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy a character of each text in each language, and the number of letters."""
        chars, of = characters(texts, table)
        sums = np.add.reduceat(self.log_p(columns(chars, of)), np.searchsorted(of, np.arange(len(texts)))).astype(np.float64)
        n = np.bincount(of, minlength=len(texts))
        return -sums / n[:, None], np.bincount(of, chars != SPACE, len(texts)).astype(np.int64)


def k_suffix(cols: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Where the grams without their first character stand in the order below."""
    return np.searchsorted(keys, hashes(cols[:-1]))


def sample(df: DataFrame, rows: int) -> DataFrame:
    """About so many rows of each language (all if there are fewer), drawn by hash, and whether each is for calibration. df: id, text, lang."""
    labelled = df.where("lang IS NOT NULL AND text IS NOT NULL")
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    unit = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    drawn = lookup(labelled, counts, "lang").where(unit < F.lit(float(rows)) / F.col("n"))
    part = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("calibration")), F.lit(1000)) < int(1000 * CALIBRATION)
    return drawn.select("text", "lang", part.alias("calibration"))


def fit(df: DataFrame, rows: int = TRAIN_ROWS) -> tuple[Model | None, dict[str, float]]:
    """The model, and each language's bound of cross-entropy. df: id, text, lang of the rows to learn from."""
    drawn = sample(df, rows)

    def count(batches):
        table, sums = letter_table(), {}
        for batch in batches:
            texts, languages = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for x in set(languages):
                for _, part in slices([t for t, own in zip(texts, languages) if own == x]):
                    cols = columns(*characters(part, table))
                    _, first, n = np.unique(hashes(cols), return_index=True, return_counts=True)
                    grams = np.stack([c[first] for c in reversed(cols)], 1).astype(np.uint32)
                    own = sums.setdefault(x, {})
                    for g, k in zip(grams, n.tolist()):
                        g = g.tobytes()
                        own[g] = own.get(g, 0) + k
        for x, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(own), pa.string()), pa.array(list(own), pa.binary()), pa.array(list(own.values()), pa.int64())], ["lang", "gram", "n"])

    grams = drawn.where("NOT calibration").select("text", F.col("lang").cast("string")).mapInArrow(count, "lang string, gram binary, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by: dict[str, tuple[list, list]] = {}
    for batch in grams.toArrow().to_batches():  # bounded by the sample
        for x, g, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
            own = by.setdefault(x, ([], []))
            own[0].append(g)
            own[1].append(n)
    if not by:
        return None, {}
    model = Model({x: (np.frombuffer(b"".join(g), np.uint32).reshape(-1, ORDER), np.array(n, np.float64)) for x, (g, n) in by.items()})
    shared = df.sparkSession.sparkContext.broadcast(model)

    def measure(batches):
        table, m = letter_table(), shared.value
        for batch in batches:
            texts, languages = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, part in slices(texts):
                h, n = m.entropies(part, table)
                own = [(languages[a + i], float(h[i, m.languages.index(languages[a + i])])) for i in range(len(part)) if n[i] and languages[a + i] in m.languages]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in own], pa.string()), pa.array([y for _, y in own], pa.float64())], ["lang", "h"])

    bounds = drawn.where("calibration").select("text", F.col("lang").cast("string")).mapInArrow(measure, "lang string, h double").groupBy("lang").agg(F.percentile("h", F.lit(CALIBRATED)).alias("h"))
    return model, {r.lang: r.h for r in bounds.collect()}


def identify(df: DataFrame, model: Model | None, bounds: dict[str, float], text: str = "text") -> DataFrame:
    """Add lang_pred, score (0 to 1), cross_entropy (nats a character) and rejected."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast((model, bounds))

    @F.arrow_udf("struct<lang_pred: string, score: double, cross_entropy: double, rejected: boolean>")
    def of(column: pa.Array) -> pa.Array:
        m, most = shared.value
        table = letter_table()
        pred, score, entropy, rejected = [], [], [], []
        for _, part in slices(column.to_pylist()):
            if m is None:
                k = len(part)
                h, n = np.zeros((k, 1)), np.zeros(k, np.int64)
            else:
                h, n = m.entropies(part, table)
            best = h.argmin(1)
            low = h[np.arange(len(part)), best]
            share = 1 / np.exp(-(h - low[:, None]) * np.minimum(n, EVIDENCE)[:, None]).sum(1)
            for i, b in enumerate(best.tolist()):
                some = n[i] > 0
                x = m.languages[b] if some else "und"
                pred.append(x)
                score.append(float(share[i]) if some else 0.0)
                entropy.append(float(low[i]) if some else None)
                rejected.append(bool(low[i] > most.get(x, np.inf)) if some else True)
        return pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(entropy, pa.float64()), pa.array(rejected, pa.bool_())], names=["lang_pred", "score", "cross_entropy", "rejected"])

    added = ("lang_pred", "score", "cross_entropy", "rejected")
    out = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in added], of(F.col(f"`{text}`")).alias("__l"))
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c not in added], *[F.col(f"__l.{a}").alias(a) for a in added])
