"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features are rates of a text, not its words: how dense words of a lexicon are, whether the
second person stands near them, capitals, punctuation, and words that hide their letters.
Beside a short list of insults there is a learned lexicon: words and beginnings of words that
the labels tie to toxic texts. All labelled rows of a bounded sample serve the lexicon, the
trees and the calibration: by folds, so that each row's features come from a lexicon that has
not seen it, and its score for the calibration from trees that have not seen it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, Window, functions as F

from folioworks.llm.batches import bound_batches, map_texts
from folioworks.session import staged

#: Labelled ids that a model is fitted on, at most: those that hash lowest, each with one text.
SAMPLE = 24_000
#: From this score on a text counts as toxic.
CUT = 0.3
#: Folds of the sample.
FOLDS = 6
#: The sample is small whatever the corpus: more partitions would only add tasks to each of the trees' jobs.
TREE_PARTITIONS = 6
#: Lengths of word beginnings that may enter the lexicon, and what it asks of an entry.
STEMS = (4, 5, 6, 7, 8)
LEAST_DOCS, LEAST_Z, LEAST_SHARE, MOST_ENTRIES = 3, 3.3, 0.4, 20_000
STRONG = 0.6

# Insults and second-person words of the corpus's languages.
INSULTS = frozenset(
    "idiot idiots moron morons stupid clown clowns worthless pathetic disgusting trash scum loser losers dumb fool fools jerk jerks garbage filth "
    "filthy creep freak imbecile cretin bastard coward liar pig pigs rat vermin parasite parasites hate ugly shut idiote stupide imbécile connard "
    "salaud ordure débile crétin nul dummkopf arschloch idioten trottel abschaum widerlich estúpido imbécil basura tonto asqueroso inútil".split()
)
SECOND_PERSON = frozenset("you your yours you're youre u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch sie usted tú ti tuyo su vosotros".split())
#: Signs that stand for letters in hidden words.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})

WORD = re.compile(r"[^\W\d_]+")
HIDDEN = re.compile(r"[A-Za-z]+(?:[0-9@$*#!|.\-]{1,2}[A-Za-z]+)+")
MAY_HIDE = re.compile(r"[A-Za-z][0-9@$*#!|.\-]{1,2}[A-Za-z]")
CAPITALS, SMALL, SIGNS, DIGITS = (bytes(x) for x in (range(65, 91), range(97, 123), [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)], range(48, 58)))
NAMES = (
    "log_words", "learned_mean", "learned_most", "learned_three", "strong_count", "strong_rate", "strong_kinds", "insult_count", "insult_rate",
    "near_second", "second_rate", "capitals", "capital_words", "shouts", "signs", "digits", "hidden_rate", "hidden_insults",
)
#: Words whose weight a worker keeps at hand.
KEPT = 1 << 18
NEAR = 4
#: Entries that a task sums up before it sends them on.
HELD = 1 << 17


def grams(word: str) -> set[str]:
    """What of a word may be in the lexicon: itself, and its beginnings (with a mark)."""
    return {word, *(word[:n] + "-" for n in STEMS if len(word) >= n)}


def features(text: str, lexicon: dict[str, float], kept: dict[str, float]) -> list[float]:
    data, words = text.encode("utf-8", "replace"), WORD.findall(text.lower())
    counts, n, total, top, strong = Counter(words), len(words) or 1, 0.0, [], set()
    for w, count in counts.items():
        if (x := kept.get(w)) is None:
            if len(kept) >= KEPT:
                kept.clear()
            x = kept[w] = max((lexicon[g] for g in grams(w) if g in lexicon), default=0.0)
        if x:
            total += x * count
            top += [x] * min(count, 3)
            if x >= STRONG:
                strong.add(w)
    top = sorted(top, reverse=True)[:3]
    insults, second = INSULTS & counts.keys(), SECOND_PERSON & counts.keys()
    n_insults, n_second, n_strong = (sum(counts[w] for w in some) for some in (insults, second, strong))
    marked = [i for i, w in enumerate(words) if w in insults or w in strong] if insults or strong else []
    near = sum(any(w in second for w in words[max(0, i - NEAR) : i + NEAR + 1]) for i in marked) if second else 0
    size = len(data) or 1
    without = lambda signs: size - len(data.translate(None, signs)) if data else 0
    capitals, small = without(CAPITALS), without(SMALL)
    tokens = text.split()
    hidden = [x for x in (HIDDEN.findall(text) if MAY_HIDE.search(text) else ()) if any(c in "0123456789@$*#!|" for c in x) or "." in x]
    unhidden = sum(re.sub("[^a-z]", "", x.lower().translate(LEET)) in INSULTS for x in hidden)
    return [
        math.log1p(len(words)), total / n, top[0] if top else 0.0, sum(top) / 3, math.log1p(n_strong), n_strong / n, len(strong) / n,
        math.log1p(n_insults), n_insults / n, near / (len(marked) or 1), n_second / n, capitals / (capitals + small or 1), sum(map(str.isupper, tokens)) / (len(tokens) or 1),
        (data.count(b"!") + data.count(b"?")) / size, without(SIGNS) / size, without(DIGITS) / size, len(hidden) / n, float(unhidden),
    ]


def with_features(docs: DataFrame, lexicon: dict[str, float], text: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` without ``text``, unless ``keep_text``, and with features (array of doubles in NAMES' order)."""

    def run(texts: Iterable[bytes]) -> Iterable[tuple]:
        kept: dict[str, float] = {}
        return ((features(x.decode("utf-8", "replace"), lexicon, kept),) for x in texts)

    return map_texts(docs, run, "features array<double>", text, keep_text)


def learn_lexicons(rows: DataFrame, folds: int = FOLDS) -> list[dict[str, float]]:
    """Rows (text, toxic 0/1, fold) to folds + 1 lexicons: without each fold, and of all rows.
    A lexicon has entries and their share of toxic texts, shrunk to the base rate.

    Each task sums up its own rows, up to HELD entries at a time; the driver gets the entries that pass
    alone, at most MOST_ENTRIES a lexicon (of the bounded sample, the most telling).
    """

    bound_batches(rows.sparkSession)

    def summed_up(counts: dict[tuple[int, int], Counter]) -> Iterator[pa.RecordBatch]:
        for (fold, label), seen in counts.items():
            n = np.fromiter(seen.values(), np.int64, len(seen))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(np.full(len(n), fold, np.int32)), pa.array(n), pa.array(n * label)], names=["gram", "fold", "n", "bad"])
        counts.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int], Counter] = {}
        for batch in batches:
            for text, label, fold in zip(*(batch.column(i) for i in range(3))):
                found = set().union(*map(grams, set(WORD.findall((text.as_py() or "").lower()))))
                counts.setdefault((fold.as_py(), label.as_py()), Counter()).update(found)
                if sum(map(len, counts.values())) > HELD:
                    yield from summed_up(counts)
        yield from summed_up(counts)

    sizes = {r.fold: (r.n, r.bad) for r in rows.groupBy("fold").agg(F.count("*").alias("n"), F.sum("toxic").alias("bad")).collect()}
    total = tuple(sum(x[i] for x in sizes.values()) for i in (0, 1))
    summed = rows.select("text", F.col("toxic").cast("int").alias("toxic"), F.col("fold").cast("int").alias("fold")).mapInArrow(run, "gram string, fold int, n long, bad long")
    own = lambda c, f: F.coalesce(F.sum(F.when(F.col("fold") == f, F.col(c))), F.lit(0)).alias(f"{c}_{f}")
    counts = summed.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), *(own(c, f) for c in ("n", "bad") for f in range(folds))).where(F.col("bad") >= LEAST_DOCS)
    told = []
    for f in [*range(folds), None]:
        n_rows, n_bad = (t - (sizes.get(f, (0, 0))[i]) for i, t in enumerate(total))
        if not 0 < n_bad < n_rows:
            continue
        base = n_bad / n_rows
        n, bad = (F.col(c) if f is None else F.col(c) - F.col(f"{c}_{f}") for c in ("n", "bad"))
        z, share = (bad - n * base) / F.sqrt(n * base * (1 - base) + 0.5), (bad + base) / (n + 1)
        told.append(F.when((bad >= LEAST_DOCS) & (z >= LEAST_Z) & (share >= LEAST_SHARE), F.struct(F.lit(folds if f is None else f).alias("which"), z.alias("z"), share.alias("share"))))
    lexicons: list[dict[str, float]] = [{} for _ in range(folds + 1)]
    if told:
        each = counts.select("gram", F.explode(F.array_compact(F.array(*told))).alias("x")).select("gram", "x.*")
        best = each.withColumn("nth", F.row_number().over(Window.partitionBy("which").orderBy(F.desc("z"), "gram"))).where(F.col("nth") <= MOST_ENTRIES)
        for r in best.collect():
            lexicons[r.which][r.gram] = r.share
    return lexicons


class ToxicityModel:
    def __init__(self, lexicon: dict[str, float], trees: GBTClassificationModel | None, calibration: IsotonicRegressionModel | None, base: float):
        self.lexicon, self.trees, self.calibration, self.base = lexicon, trees, calibration, base

    def score(self, docs: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
        """``docs`` without ``text``, unless ``keep_text``, and with score."""
        rows = with_features(docs, self.lexicon, text, keep_text)
        return self._scored(rows).drop("features")

    def _raw(self, rows: DataFrame) -> DataFrame:
        made = self.trees.transform(rows.withColumn("_vector", array_to_vector("features")))
        return made.withColumn("_raw", vector_to_array("_probability")[1]).drop("_vector", "_rawPrediction", "_probability", "_prediction")

    def _scored(self, rows: DataFrame) -> DataFrame:
        if self.trees is None:
            return rows.withColumn("score", F.lit(self.base))
        if self.calibration is None:
            return self._raw(rows).withColumnRenamed("_raw", "score")
        made = self.calibration.transform(self._raw(rows)).withColumnRenamed("_calibrated", "score").drop("_raw")
        return made.withColumn("score", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)))


def _grown(rows: DataFrame) -> GBTClassificationModel:
    shape = {"maxDepth": 3, "maxIter": 24, "stepSize": 0.2, "minInstancesPerNode": 4, "seed": 8}
    learner = GBTClassifier(featuresCol="_vector", labelCol="toxic", predictionCol="_prediction", checkpointInterval=-1, **shape)
    learner = learner.setProbabilityCol("_probability").setRawPredictionCol("_rawPrediction")
    return learner.fit(rows.withColumn("_vector", array_to_vector("features")).coalesce(TREE_PARTITIONS))


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column | None = None, id_col: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> ToxicityModel:
    """A model from at most ``sample`` labelled ids; ``may_learn`` (over labels) leaves rows out.

    Rows without id or label are left out, and of several labels for one id the highest counts;
    of several texts of one id the one that hashes lowest. Without any toxic or any clean label
    the score is the share of toxic ones (none, or an empty table: 0).
    """
    told = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull())
    told = told if may_learn is None else told.where(may_learn)
    chosen = told.groupBy(F.col(id_col).alias("id")).agg(F.max("toxic").alias("toxic")).withColumn("_h", F.xxhash64("id")).orderBy("_h", "id").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id").withColumn("_t", F.xxhash64("text"))
    one = texts.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("_t"))).where("_n = 1")  # cut in each task before the shuffle
    rows = staged(one.select("text", "toxic", F.pmod(F.hash("_h", F.lit(7)), F.lit(FOLDS)).alias("fold")), "labelled")
    parts = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    base = parts.get(1, 0) / max(1, sum(parts.values()))
    if len(parts) < 2:
        return ToxicityModel({}, None, None, base)
    lexicons = learn_lexicons(rows)
    apart = (with_features(rows.where(F.col("fold") == f), lexicons[f]) for f in range(FOLDS))
    seen = staged(reduce(DataFrame.unionByName, apart), "features")
    half = F.col("fold") % 2 == 0
    held = []
    for mine in (half, ~half):
        if seen.where(mine).select("toxic").distinct().count() == 2:
            held.append(ToxicityModel({}, _grown(seen.where(mine)), None, base)._raw(seen.where(~mine)).select("_raw", "toxic"))
    model = ToxicityModel(lexicons[-1], _grown(seen), None, base)
    if held:
        # Rows of one raw score are one weighted point, so that no task gets them all.
        points = reduce(DataFrame.unionByName, held).groupBy("_raw").agg(F.avg("toxic").alias("toxic"), F.count("*").cast("double").alias("_weight"))
        model.calibration = IsotonicRegression(featuresCol="_raw", labelCol="toxic", predictionCol="_calibrated", weightCol="_weight").fit(points)
    return model


def learnable(id_col: str = "doc_id") -> Column:
    """Rows that a model may learn from: crc32 of the id as text, modulo 4, is not 2."""
    return F.crc32(F.col(id_col).cast("string")) % 4 != 2


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, held_out, score (0 to 1) and predicted (score of CUT or more).

    Whole texts are scored, null and empty ones too; equal texts have equal scores, and repeated
    rows stay repeated. A null id is not held out. Only texts make a score; labels fit the model
    on rows that are not held out. An empty table gives no rows; other columns play no part,
    also those named score, features or toxic.
    """
    model = fit(docs, labels, learnable(id_col), id_col, text)
    scored = model.score(docs.select(F.col(id_col), F.col(text).alias("text")))
    held_out = ~F.coalesce(learnable(id_col), F.lit(True))
    return scored.select(id_col, held_out.alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))
