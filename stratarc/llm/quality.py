"""Quality classifier by co-training of a text view and a page-metadata view.

The text view sees what is written: shares of character classes, word lengths and shapes, repetition of words and pairs of words. The metadata
view sees what the table says about the page and nothing of its text: language, source and the given number of characters (n_chars, where docs has
it). Each is a logistic regression with standardised inputs. In every round each classifier scores all documents without a label and hands
the HANDED surest of either class to the other as pseudo-labels; equal documents count once. How sure a view may be is calibrated each round on
labelled rows that it wasn't fitted on (FOLDS parts in turn), so a view that knows little hands over nothing, as both do with fewer than LEAST labels of a class. In the end a logistic regression over both
calibrated logits, fitted on other held-out rows than the calibration, scores all documents.

Fitting uses at most FIT_ROWS labelled rows, chosen by a hash of doc_id, and what is handed over. Rounds and scoring read every
row and whole text. Rows are rejected when the combined score is below THRESHOLD, low enough to keep doubtful documents.

Nulls: a null text counts as empty, null lang, source or n_chars as a value of its own, null labels as unlabelled. Empty texts have all-zero text
features and are scored like others. Rows that repeat a doc_id are each scored, and one of them, by a hash of what it holds, is fitted; several labels for a doc_id are averaged and count as 1
from 0.5 on. Without both classes among the labels everything gets score 1 and is accepted. An empty table gives an empty result. Columns other
than those named are carried along only by ``keep_good``, under any name.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratarc.llm.common import discard, id_hash, split_words, written
from stratarc.llm.tokens import text_slices

FIT_ROWS = 12_000
ROUNDS = 4
#: Pseudo-labels of both classes that each view hands over in a round at most, in the proportion of the classes.
HANDED = 500
#: By how much a pseudo-label's calibrated log odds have to differ from those of the classes' shares, and parts in which rows are held out to calibrate.
SURE, FOLDS = 2.5, 5
#: Labelled rows of each class without which nothing is handed over.
LEAST = 10
THRESHOLD = 0.2
SHAPES = 48
#: Text bytes that are counted at once.
PIECE = 1 << 20
#: Text bytes that are split into words at once.
SLICE = 2_000_000
HASHED = 24

_CLASSES = np.full(256, 0, np.uint8)
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".", b",;:", b"!", b"?", b"*", b"$", b"#", b"%", b"&", b"|", b"'\"()-", b"<>{}[]=/\\_~^+@`"), 1):
    _CLASSES[list(_chars)] = _i
_CLASSES[128:] = 18
N_CLASSES = 19


def _repeats(keys: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Distinct keys of each text."""
    if not len(keys):
        return np.zeros(docs)
    order = np.lexsort((keys, doc))
    k, d = keys[order], doc[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])])
    return np.bincount(d[new], minlength=docs).astype(float)


def _classes_of(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Counts of character classes [texts, classes], taken in pieces, so that no array is many times as long as a text."""
    out = np.zeros((len(ends), N_CLASSES))
    for a in range(0, len(data), PIECE):
        b = min(a + PIECE, len(data))
        lo, hi = np.searchsorted(ends, a, "right"), np.searchsorted(ends, b, "left") + 1
        each = np.diff(np.clip(ends[lo:hi], a, b), prepend=a)
        doc = np.repeat(np.arange(hi - lo, dtype=np.int32), each)
        doc *= N_CLASSES
        doc += _CLASSES[data[a:b]]
        out[lo:hi] += np.bincount(doc, minlength=(hi - lo) * N_CLASSES).reshape(-1, N_CLASSES)
    return out


def text_view(texts: pa.Array) -> np.ndarray:
    texts = pc.fill_null(texts, "")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32 if texts.type == pa.string() else np.int64)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if n else np.empty(0, np.uint8)
    chars = _classes_of(data, offsets[1:] - offsets[0])
    size = np.maximum(np.diff(offsets), 1)[:, None]
    unique, codes, word_ends = split_words(texts)
    owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(np.concatenate([[0], word_ends])))
    words = np.maximum(np.bincount(owner, minlength=n), 1)
    lengths = pc.binary_length(unique).to_numpy(zero_copy_only=False).astype(float) if len(unique) else np.empty(0)
    per = np.bincount(owner, lengths[codes], minlength=n) / words
    shapes = _shapes(unique)
    shaped = np.bincount(owner.astype(np.int64) * SHAPES + shapes[codes], minlength=n * SHAPES).reshape(n, SHAPES) if len(codes) else np.zeros((n, SHAPES))
    distinct = _repeats(codes, owner, n) / words
    same = owner[1:] == owner[:-1] if len(owner) else np.empty(0, bool)
    pair = (codes[:-1].astype(np.int64) << 32 | codes[1:])[same] if len(codes) else np.empty(0, np.int64)
    pairs = _repeats(pair, owner[1:][same] if len(owner) else owner, n) / words
    return np.column_stack([np.sqrt(chars / size), np.sqrt(shaped / words[:, None]), per / 10, distinct, pairs])


def _shapes(unique: pa.Array) -> np.ndarray:
    """A hashed class of each word: letter case, digits, whether it is short, what mark it ends with and whether three times."""
    if not len(unique):
        return np.empty(0, np.int64)
    unique = unique.cast(pa.string())
    tail, third = pc.utf8_slice_codeunits(unique, -1), pc.utf8_slice_codeunits(unique, -3, -2)
    mark = pc.if_else(pc.utf8_is_alpha(tail), "", tail)
    short = pc.less(pc.utf8_length(unique), 4)
    flags = [pc.utf8_is_upper(unique), pc.utf8_is_upper(pc.utf8_slice_codeunits(unique, 0, 1)), pc.utf8_is_alpha(unique), pc.utf8_is_digit(unique), short, pc.equal(third, mark)]
    kinds = pc.binary_join_element_wise(*[pc.if_else(f, "1", "0") for f in flags], mark, "").dictionary_encode()
    classes = np.array([zlib.crc32(k.encode()) % SHAPES for k in kinds.dictionary.to_pylist()], np.int64)
    return classes[kinds.indices.to_numpy(zero_copy_only=False)]


def meta_view(langs: pa.Array, sources: pa.Array, sizes: pa.Array) -> np.ndarray:
    hashed = np.zeros((len(langs), 2 * HASHED))
    for at, column in ((0, langs), (HASHED, sources)):
        for i, v in enumerate(column.to_pylist()):
            hashed[i, at + zlib.crc32(repr(v).encode()) % HASHED] = 1
    n = pc.fill_null(sizes, -1).to_numpy(zero_copy_only=False).astype(float)
    log = np.log1p(np.maximum(n, 0))
    return np.column_stack([log / 10, (log / 10) ** 2, n < 0, *((n >= 0) & (n < k) for k in (50, 200, 800, 3200)), hashed])


class Logistic:
    """Standardised logistic regression fitted by Newton steps with a ridge."""

    def __init__(self, ridge: float = 1.0) -> None:
        self.ridge = ridge

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, steps: int = 12) -> Logistic:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])
        w = np.zeros(z.shape[1])
        pull = np.full(len(w), self.ridge)
        pull[0] = 1e-6
        k = np.ones(len(x)) if weight is None else weight
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            h = (z * (k * (p * (1 - p) + 1e-6))[:, None]).T @ z + np.diag(pull)
            step = np.linalg.solve(h, z.T @ (k * (y - p)) - pull * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        self.w = w
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.w[0] + ((x - self.mean) / self.scale) @ self.w[1:], -30, 30)


class CoTraining:
    """Two views' classifiers, their calibration and their combination."""

    def fit(self, views: tuple[np.ndarray, np.ndarray], y: np.ndarray, surest, rounds: int = ROUNDS) -> CoTraining:
        """views: text and metadata features of labelled rows; surest(models, calibration, good share): for each view, the rows (text, meta, label) that it hands over."""
        # folds and halves that have their share of both classes
        turn = np.empty(len(y), np.int64)
        for c in np.unique(y):
            turn[y == c] = np.arange((y == c).sum())
        more: list[list[tuple]] = [[], []]
        for left in range(rounds, -1, -1):
            learn = lambda v, rows: Logistic().fit(*(np.concatenate(x) for x in zip((views[v][rows], y[rows], np.ones(rows.sum())), *more[v], strict=True)))  # noqa: B023, E731
            self.models = [learn(v, np.ones(len(y), bool)) for v in (0, 1)]
            # what a view is worth shows on rows that it wasn't fitted on
            unseen = [np.zeros(len(y)), np.zeros(len(y))]
            for f in range(FOLDS):
                mine = turn % FOLDS == f
                if mine.any() and len(np.unique(y[~mine])) == 2:
                    for v in (0, 1):
                        unseen[v][mine] = learn(v, ~mine).logit(views[v][mine])
            half = turn // FOLDS % 2 == 0
            if len(np.unique(y[~half])) < 2:
                half = np.ones(len(y), bool)
            self.calibration = [Logistic(1.0).fit(x[half][:, None], y[half]) for x in unseen]
            if left and min((y == c).sum() for c in (0, 1)) >= LEAST:
                for v, rows in enumerate(surest(self.models, self.calibration, y.mean())):
                    if rows is not None:
                        more[1 - v].append((rows[1 - v], rows[2], np.full(len(rows[2]), 0.3)))
        rest = ~half if (~half).any() else half
        both = np.column_stack([c.logit(x[rest][:, None]) for c, x in zip(self.calibration, unseen, strict=True)])
        self.combined = Logistic(1.0).fit(both, y[rest])
        return self

    def scores(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Columns: calibrated probability of each view and of both."""
        logits = [c.logit(m.logit(v)[:, None]) for c, m, v in zip(self.calibration, self.models, (text, meta), strict=True)]
        logits.append(self.combined.logit(np.column_stack(logits)))
        return 1 / (1 + np.exp(-np.column_stack(logits)))


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return text_view(batch.column("text")), meta_view(batch.column("lang"), batch.column("source"), batch.column("n_chars"))


def _packed(rows: DataFrame) -> DataFrame:
    """doc_id, y, and both views' features as binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, "text", SLICE):
                text, meta = (np.ascontiguousarray(x, dtype="<f4") for x in _views(batch))
                cells = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (text, meta)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), *cells], names=["doc_id", "y", "text", "meta"])

    return rows.mapInArrow(run, "doc_id long, y double, text binary, meta binary")


def _features(column) -> np.ndarray:
    return np.stack([np.frombuffer(b, "<f4") for b in column]).astype(float)


def _surest(pool: DataFrame, handed: int):
    """The function that CoTraining.fit asks for pseudo-labels: every round scores the whole pool, and no row is handed over twice."""
    given: set[tuple[bytes, bytes]] = set()

    def ask(models: list[Logistic], calibration: list[Logistic], share: float) -> list:
        good, prior = max(1, int(handed * share)), math.log(share / (1 - share))
        # per view and class: rows wanted, and the sign that puts the surest first
        lists = [(v, mark, n, sign) for v in (0, 1) for mark, n, sign in ((1.0, good, -1), (0.0, max(1, handed - good), 1))]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[list[tuple]] = [[] for _ in lists]
            for batch in batches:
                cells = [batch.column(c).to_pylist() for c in ("text", "meta")]
                logits = [k.logit(m.logit(_features(c))[:, None]) - prior for k, m, c in zip(calibration, models, cells, strict=True)] if batch.num_rows else []
                for mine, (v, _, n, sign) in zip(held, lists, strict=True):
                    if not batch.num_rows or calibration[v].w[1] <= 0:
                        continue
                    key = sign * logits[v]
                    bar = mine[-1][0] if len(mine) == n else -SURE
                    rows = [(float(key[i]), cells[0][i], cells[1][i]) for i in np.flatnonzero(key <= min(bar, -SURE)).tolist()]
                    mine[:] = sorted(mine + [r for r in rows if r[1:] not in given])[:n]
            for k, mine in enumerate(held):
                if mine:
                    yield pa.RecordBatch.from_pydict({"list": pa.array([k] * len(mine), pa.int32()), "key": [r[0] for r in mine], "text": pa.array([r[1] for r in mine], pa.binary()), "meta": pa.array([r[2] for r in mine], pa.binary())})

        # at most so many rows a task as are wanted; dealt by list, so that they make few files
        best = written(pool.mapInArrow(run, "list int, key double, text binary, meta binary").repartition("list"), "quality-round")
        out = []
        for view in (0, 1):
            picks = []
            for k, (v, mark, n, _) in enumerate(lists):
                if v == view:
                    rows = best.where(F.col("list") == k).orderBy("key", "text", "meta").limit(n).collect()
                    rows = [r for r in ((bytes(r["text"]), bytes(r["meta"])) for r in rows) if r not in given]
                    given.update(rows)
                    picks += [(*r, mark) for r in rows]
            out.append((_features([p[0] for p in picks]), _features([p[1] for p in picks]), np.array([p[2] for p in picks])) if picks else None)
        return out

    return ask


def _named(docs: DataFrame) -> DataFrame:
    """The columns that are read; n_chars is null where docs has none."""
    size = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), size.alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, pool_rows: int = HANDED, rounds: int = ROUNDS) -> CoTraining | None:
    """Fit on at most about fit_rows labelled rows and what each view hands over, at most pool_rows a round; None without both classes.

    docs: doc_id, text, lang, source and, if it has it, n_chars; labels: doc_id, quality.
    """
    docs = _named(docs)
    marks = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    n = marks.count()
    if n > fit_rows:
        marks = marks.where(id_hash(F.col("doc_id")) % 1_000_003 < int(1_000_003 * fit_rows / n))
    marks = written(marks, "quality-labels")
    # the labels are bounded by fit_rows, so they may be broadcast; which of a doc_id's rows is taken depends on what they hold alone
    columns = ("text", "lang", "source", "n_chars")
    rows = docs.join(F.broadcast(marks), "doc_id").select("doc_id", "y", F.struct(F.xxhash64(*columns).alias("hash"), *columns).alias("row"))
    one = rows.groupBy("doc_id").agg(F.first("y").alias("y"), F.min("row").alias("row")).select("doc_id", "y", *[f"row.{c}" for c in columns])
    sample = _packed(one).toPandas().sort_values("doc_id", kind="stable")
    if not len(sample) or sample["y"].nunique() < 2:
        return None
    views = _features(sample["text"]), _features(sample["meta"])
    if not rounds:
        return CoTraining().fit(views, sample["y"].to_numpy(), None, 0)
    # all rows without a label are the pool; equal ones are one
    known = written(labels.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "quality-known")
    every = _packed(docs.withColumn("y", F.lit(-1.0))).select("doc_id", "text", "meta")
    pool = written(every.join(known, "doc_id", "left_anti").groupBy("text", "meta").agg(F.count("*").alias("rows")).select("text", "meta"), "quality-pool")
    model = CoTraining().fit(views, sample["y"].to_numpy(), _surest(pool, pool_rows), rounds)
    discard(docs.sparkSession, pool, known, marks)
    return model


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """doc_id, text_score, meta_score, score and accepted of every row."""
    model = train(docs, labels, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, "text", SLICE):
                p = model.scores(*_views(batch)) if model else np.ones((batch.num_rows, 3))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(p[:, k]) for k in range(3)), pa.array(p[:, 2] >= threshold)], names=["doc_id", "text_score", "meta_score", "score", "accepted"])

    return written(_named(docs).mapInArrow(run, "doc_id long, text_score double, meta_score double, score double, accepted boolean"), "quality-scores")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """docs without the rejected rows, in one pass over them; docs' own columns."""
    model = train(docs, labels, **options)
    if model is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, "text", SLICE):
                langs, sources = (batch.column(c).cast(pa.string()) for c in ("lang", "source"))
                sizes = batch.column("n_chars").cast(pa.float64()) if "n_chars" in batch.schema.names else pa.nulls(batch.num_rows, pa.float64())
                yield batch.filter(pa.array(model.scores(text_view(batch.column("text")), meta_view(langs, sources, sizes))[:, 2] >= threshold))

    # written here, where batches are bounded, and not in whatever job the caller has
    return written(docs.mapInArrow(run, docs.schema), "quality-kept")


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents, with the table's quality labels."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
