"""Operator 10: URL filter by host word segmentation and naive Bayes.

Host names are runs of words without spaces. A unigram model of the words of the pages splits them by Viterbi; the words of host and path then
go to a multinomial naive Bayes classifier. It learns from the URLs themselves: those whose delimited host words include a seed word are
taken as unwanted, the others as wanted, so that words that come with the seeds count as well. A table of labels can take the seeds' place.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, ensure_importable

SEEDS = ("casino", "bets", "betting", "poker", "pills", "viagra", "pharma", "spam", "adult", "porn", "xxx", "sex", "ads", "malware", "phishing")
#: Longer words are found by their first so many letters.
_PREFIX = 24
_GENERIC = frozenset("www com net org http https html htm php index".split())
_UNKNOWN, _NUMBER = "<unk>", "<num>"
_SPLIT = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::\d+)?([^?#]*)", re.I)
_RUNS = re.compile(r"[^\W\d_]+|\d+")


def host_and_path(url: str) -> tuple[str, str]:
    m = _SPLIT.match(url.strip() if "://" in url else "http://" + url.strip())
    return (m.group(1).lower(), m.group(2)) if m else ("", "")


class Segmenter:
    """Splits runs of letters into the most likely words of a unigram model."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        """total: of the whole model, if counts are those of a part of it."""
        total = total or sum(counts.values()) + len(counts) + 1
        self.cost = {w: -math.log((c + 1) / total) for w, c in counts.items()}
        # an unknown stretch costs more than a word of the model for every letter
        self.unknown, self.letter = math.log(total), math.log(26) + 1.0
        self.lengths = sorted({len(w) for w in counts}, reverse=True)
        self.memo: dict[str, list[str]] = {}

    def words(self, run: str) -> list[str]:
        """Words of a run of letters; stretches that the model doesn't know stay together. Of equally likely splits the one with the longer last word."""
        known = self.memo.get(run)
        if known is not None:
            return known
        n = len(run)
        best, back, new = [0.0] + [math.inf] * n, [0] * (n + 1), [False] * (n + 1)
        # best_unknown[i]: cheapest split of the first i letters that ends in an open unknown stretch
        open_cost, open_from = [math.inf] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            start, go_on = best[i - 1] + self.unknown + self.letter, open_cost[i - 1] + self.letter
            open_cost[i], open_from[i] = (go_on, open_from[i - 1]) if go_on <= start else (start, i - 1)
            best[i], back[i] = open_cost[i], open_from[i]
            for length in self.lengths:
                k = i - length
                c = self.cost.get(run[k:i]) if k >= 0 else None
                if c is not None and best[k] + c < best[i]:
                    best[i], back[i] = best[k] + c, k
        out, at = [], n
        while at:
            out.append(run[back[at] : at])
            at = back[at]
        out.reverse()
        if len(self.memo) > 200_000:
            self.memo.clear()
        self.memo[run] = out
        return out

    def tokens(self, url: str) -> tuple[list[str], list[str], list[str]]:
        """Delimited words of the host, segmented words of the host (less the top-level domain and www), and of the path."""
        host, path = url_runs(url)
        split, rest = ([w for r in runs for w in ([r] if r == _NUMBER else self.words(r))] for runs in (host, path))
        return host, split, rest


def url_runs(url: str) -> tuple[list[str], list[str]]:
    """Runs of letters, and marks of numbers, of the host (less the top-level domain and www) and of the path."""
    host, path = host_and_path(url)
    labels = host.split(".")
    runs = [r for label in labels[: max(1, len(labels) - 1)] for r in _RUNS.findall(label)], _RUNS.findall(path.lower())
    first, rest = ([_NUMBER if r.isdigit() else r for r in part if r not in _GENERIC] for part in runs)
    return first, rest


def word_counts(df: DataFrame, text_col: str, url_col: str, seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """(w, count) of all words of the pages' text (tags removed), of the words of URL parts that a delimiter splits in two or more, and of the seeds (0 if they don't occur).
    A part that is one run of letters may be several words and tells nothing."""
    text = F.regexp_replace(F.coalesce(df[text_col].cast("string"), F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>|&\w+;", " ")
    page = df.select(F.explode(F.split(F.lower(text), r"[^\p{L}]+")).alias("w"))
    part = df.select(F.explode(F.split(F.lower(df[url_col].cast("string")), r"[./:?#&=@]+")).alias("p")).select(F.regexp_extract_all("p", F.lit(r"\p{L}+"), F.lit(0)).alias("ws"))
    url = part.where(F.size("ws") > 1).select(F.explode("ws").alias("w"))
    words = page.unionByName(url).where(F.length("w") > 0).groupBy("w").count()
    always = df.sparkSession.createDataFrame([(w, 0) for w in seeds], "w string, count bigint")
    return checkpointed(words.unionByName(always).groupBy("w").agg(F.sum("count").alias("count")))


def _runs(bad: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [url_runs(u) for u in batch.column(0).to_pylist()]
            runs = pa.array([h + p for h, p in both], pa.list_(pa.string()))
            label = pa.array([bool(bad.intersection(h)) for h, _ in both], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), runs, pa.array([len(h) for h, _ in both], pa.int32()), label], names=["url", "n", "runs", "n_host", "label"])

    return run


def _substrings(least: int):
    """(run, w) for every substring w of `least` to _PREFIX letters of every run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.column(0).to_pylist():
                for at in range(0, len(r), 2000):  # starts that are taken at a time
                    found = list({r[i:k] for i in range(at, min(len(r), at + 2000)) for k in range(i + least, min(len(r), i + _PREFIX) + 1)})
                    yield pa.RecordBatch.from_arrays([pa.array([r] * len(found), pa.string()), pa.array(found, pa.string())], names=["run", "w"])

    return run


def _own_words(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """(run, own ARRAY<STRUCT<w, count>>): the words that occur in each run. Longer words than _PREFIX meet the runs by their first letters and are looked for there."""
    short = runs.mapInArrow(_substrings(1), "run string, w string").join(counts, "w").select("run", "w", "count")
    starts = runs.where(F.length("run") > _PREFIX).mapInArrow(_substrings(_PREFIX), "run string, start string").distinct()
    long = counts.where(F.length("w") > _PREFIX).select(F.substring("w", 1, _PREFIX).alias("start"), "w", "count")
    more = starts.join(long, "start").where(F.contains("run", "w")).select("run", "w", "count")
    return short.unionByName(more).groupBy("run").agg(F.collect_set(F.struct("w", "count")).alias("own"))


def _segments(total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, known = [], []
            for r, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                model = Segmenter({x["w"]: x["count"] for x in own or ()}, total)
                words.append(model.words(r))
                known.append([w if w in model.cost else _UNKNOWN for w in words[-1]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string())), pa.array(known, pa.list_(pa.string()))], names=["run", "words", "known"])

    return run


def _even(alpha: float, n_bad: int, n_good: int, v: int) -> float:
    """Log odds of a word that no URL of the training has."""
    return math.log(alpha / (n_bad + alpha * v)) - math.log(alpha / (n_good + alpha * v))


def score_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", seeds: tuple[str, ...] = SEEDS, alpha: float = 0.5, threshold: float = 0.0, labels: DataFrame | None = None) -> DataFrame:
    """(id_col, url, host_words ARRAY<STRING>, score DOUBLE, blocked BOOLEAN) of every row of df.

    The classifier learns from labels (url, unwanted BOOLEAN) if they are given: from the rows whose URL has one (of several, unwanted wins), and scores all rows; otherwise
    from the seeds. score is the log odds of unwanted against wanted, with Laplace smoothing alpha; blocked whether it is above the threshold. A null URL has
    nulls and isn't blocked; an empty URL, or one without words, has the prior odds alone. Repeated rows and null ids are kept and counted each; a null
    page text adds no words; a column of df that has a result's name is ignored unless it is the one read; an empty table gives no
    rows. Without any unwanted URL to learn from nothing is blocked. URLs and texts are read whole. All words count, and words meet
    counts and weights by joins, so that neither model is cut or collected; work is on distinct URLs and on distinct runs of letters.
    """
    spark = ensure_importable(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    counts = word_counts(df, text_col, url_col, seeds)
    total = counts.agg(F.coalesce(F.sum(F.col("count") + 1), F.lit(0))).first()[0] + 1
    rows = df.select(df[id_col].alias("id"), df[url_col].cast("string").alias("url"))
    each = checkpointed(rows.where("url is not null").groupBy("url").agg(F.count("*").alias("n")).mapInArrow(_runs(frozenset(seeds)), "url string, n bigint, runs array<string>, n_host int, label boolean"))
    if labels is not None:
        told = labels.where("url is not null and unwanted is not null").groupBy(F.col("url").cast("string").alias("url")).agg(F.max("unwanted").alias("label"))
        each = each.drop("label").join(told, "url", "left")

    runs = checkpointed(each.select(F.explode("runs").alias("run")).where(F.col("run") != _NUMBER).distinct())
    split = runs.join(_own_words(runs, counts), "run", "left").select("run", "own").mapInArrow(_segments(total), "run string, words array<string>, known array<string>")
    split = split.unionByName(spark.createDataFrame([(_NUMBER, [_NUMBER], [_NUMBER])], split.schema))
    placed = each.select("url", "n_host", F.posexplode("runs").alias("pos", "run")).join(split, "run")
    joined = placed.groupBy("url").agg(F.array_sort(F.collect_list(F.struct("pos", "words", "known", (F.col("pos") < F.col("n_host")).alias("host")))).alias("x"))
    host = F.flatten(F.transform(F.filter("x", lambda p: p["host"]), lambda p: p["words"]))
    known = F.flatten(F.transform("x", lambda p: p["known"]))
    none = F.array().cast("array<string>")
    words = joined.select("url", host.alias("host_words"), known.alias("words"))
    words = checkpointed(each.select("url", "n", "label").join(words, "url", "left").select("url", "n", "label", F.coalesce("host_words", none).alias("host_words"), F.coalesce("words", none).alias("words")))

    prior = {r.label: r.n for r in words.where("label is not null").groupBy("label").agg(F.sum("n").alias("n")).collect()}
    if prior.get(True):
        per = words.where("label is not null").select("n", "label", F.explode("words").alias("w")).groupBy("w").agg(F.sum(F.when(F.col("label"), F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("label"), 0).otherwise(F.col("n"))).alias("good"))
        per = checkpointed(per)
        n_bad, n_good, v = per.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0)), F.count("*") + 1).first()
        odds = F.log((F.col("bad") + alpha) / (n_bad + alpha * v)) - F.log((F.col("good") + alpha) / (n_good + alpha * v))
        base = math.log((prior[True] + alpha) / (prior.get(False, 0) + alpha))
        of = words.select("url", F.explode("words").alias("w")).join(per.select("w", odds.alias("o")), "w", "left").withColumn("o", F.coalesce("o", F.lit(_even(alpha, n_bad, n_good, v)))).groupBy("url").agg(F.array_sort(F.collect_list("o")).alias("o"))
        scored = words.select("url", "host_words").join(of, "url", "left")
        scored = scored.select("url", "host_words", (F.lit(base) + F.coalesce(F.aggregate("o", F.lit(0.0), lambda a, x: a + x), F.lit(0.0))).alias("score"))
    else:
        scored = words.select("url", "host_words", F.lit(-1e6).alias("score"))
    out = rows.where("url is not null").join(scored, "url").select("id", "url", "host_words", "score", (F.col("score") > threshold).alias("blocked"))
    nulls = rows.where("url is null").select("id", "url", F.lit(None).cast("array<string>").alias("host_words"), F.lit(None).cast("double").alias("score"), F.lit(False).alias("blocked"))
    return out.unionByName(nulls).select(F.col("id").alias(id_col), "url", "host_words", "score", "blocked")
