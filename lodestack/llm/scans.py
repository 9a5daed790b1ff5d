"""Noise in text from scanned pages (problem 4).

1. Scans are told from clean texts, and their running lines and page numbers are found, by
   the classifiers of pages.py. A document becomes one row of arrays.
2. All words of the corpus are counted, apart for clean texts and scans; a word divided at
   a line's end counts with its halves joined.
3. Words that clean texts don't have meet their correction candidates in an inverted join
   of character q-grams: by their rarest grams, of which words within EDITS edits share
   one at nearly the same place, then by the number of shared grams. Gradient-boosted trees rank the candidates;
   they are trained on words of the corpus that are misread on purpose, and on rare words
   of clean texts, which have no correction.
4. Line pairs around a hyphen are joined or kept by boosted trees over the counts of the
   joined word, its halves and the compound, trained on words divided on purpose and on
   compounds and codes.
5. The text is given back without running lines, with divided words joined and misread
   words replaced, one line a paragraph.

The classifiers are fitted on bounded samples: `sample_docs` documents for pages,
and for pages the first 3000 of their paragraphs, `sample_words` words for words and
hyphens, with at most LEARN_PAIRS of their candidates. Counts, candidates and decisions cover all.

Defined cases: null and blank contents give no lines; clean texts have no cases; of a
repeated id the row with the latest update counts, then the longest text; words without a
candidate are misread only if they hold a sign that no word has; an empty table gives no
rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.boosting import Boosted
from lodestack.llm.pages import HYPHENS, MISREAD, SYMBOLS, Furniture, misread, paragraphs_of
from lodestack.session import Shared, cut, spread, table

EDITS, GRAM = 2, 2
PREFIX = EDITS * GRAM + 1
SAMPLE_DOCS, SAMPLE_WORDS, LEARN_PAIRS = 600, 4000, 200_000
ODD_SIGNS = "†¢ſ@!|"
_OUTER = ".,;:()[]{}\"'«»“”„*#?_~<>"
_CODE = re.compile(r"^[A-Za-z]{1,4}[-‐¬­]?[\dOolIS]{3,}$")
_NUMERIC = re.compile(r"^[\d.,/%+\-–$€£°]+$")
_WORDISH = re.compile(r"[^\W\d_]")
_ELIDED, _APOSTROPHE = re.compile(r"^[^\W\d_]{1,2}['’]"), re.compile(r"['’]")


def tokens(line: str) -> list[str]:
    """Words of a line in lower case, without outer punctuation, elided articles, numbers and codes."""
    out = []
    for raw in line.split():
        w = raw.strip(_OUTER)
        # Nearly all words are letters and can only be taken for a code by their last one.
        if w.isalpha() and w[-1] not in "OolIS":
            if "|" not in raw[1:-1]:
                out.append(w.lower())
            continue
        if not w or _NUMERIC.match(w) or not _WORDISH.search(w) or _CODE.match(w) or "|" in raw[1:-1]:
            continue
        w = _APOSTROPHE.split(w)[-1] if _ELIDED.match(w) else w
        out.append(w.lower())
    return [w for w in out if w]


def parts(word: str) -> list[str]:
    return [p for p in word.split("-") if p] if "-" in word else [word]


def odd(word: str) -> bool:
    """Whether a word holds a sign or digit that no word has."""
    if word.isalpha() and "ſ" not in word:
        return False
    inner = word.strip("!|")
    if any(c in ODD_SIGNS for c in inner):
        return not ("@" in inner and "." in inner.split("@")[-1])
    return any(c.isdigit() for c in word) and sum(c.isalpha() for c in word) >= 2 and bool(re.fullmatch(r"[^\W_]+", word)) and not re.match(r"^[a-z]{1,3}\d+$|^\d+[a-z]{1,3}$", word)


def divided(lines: list[str], kinds: list[str]) -> dict[int, tuple[int, str, str, str]]:
    """Lines that end with a hyphen after a letter: (next text line, left half, right half, hyphen)."""
    text = [i for i, k in enumerate(kinds) if k == "text"]
    out = {}
    for i, j in zip(text, text[1:]):
        line = lines[i].rstrip()
        if len(line) < 2 or line[-1] not in HYPHENS or not line[-2].isalnum():
            continue
        left = re.split(r"[\s'’(\"]", line[:-1])[-1].strip(_OUTER)
        following = lines[j].replace("\x0c", "").split()
        right = following[0].strip(_OUTER) if following else ""
        if left and right:
            out[i] = (j, left, right, line[-1])
    return out


def document_words(lines: list[str], kinds: list[str] | None) -> tuple[list[str], list[int], list[tuple], list[tuple]]:
    """Of a document: its words and the line of each (0 in clean texts), (line, next, left, right, hyphen) of
    the divided lines, and (line, kind) of running lines and page numbers; lines count from 1."""
    words: list[str] = []
    at: list[int] = []
    if kinds is None:
        for line in lines:
            for w in tokens(line):
                words += {w, *parts(w)} if "-" in w else (w,)
        return words, [0] * len(words), [], []
    furniture = [(i + 1, k) for i, k in enumerate(kinds) if k in ("header", "page_number")]
    pairs = divided(lines, kinds)
    starts = {v[0]: v[2] for v in pairs.values()}
    for i, k in enumerate(kinds):
        if k != "text":
            continue
        line = lines[i].replace("\x0c", " ")
        if i in starts:
            line = line.replace(starts[i], " ", 1)
        if i in pairs:
            words.append((pairs[i][1] + pairs[i][2]).lower())
            at.append(-i - 1)
            line = line.rstrip()[: -1 - len(pairs[i][1])]
        own = {p for w in tokens(line) for p in ((w,) if "-" not in w or odd(w) else (w, *parts(w)))}
        words += own
        at += [i + 1] * len(own)
    return words, at, [(i + 1, v[0] + 1, *v[1:]) for i, v in pairs.items()], furniture


ROWS = (
    "id string, scan boolean, words array<string>, at array<int>, pairs array<struct<line:int,next:int,left:string,right:string,sign:string>>, "
    "furniture array<struct<line:int,kind:string>>"
)
_PAIRS = pa.list_(pa.struct([("line", pa.int32()), ("next", pa.int32()), ("left", pa.string()), ("right", pa.string()), ("sign", pa.string())]))
_FURNITURE = pa.list_(pa.struct([("line", pa.int32()), ("kind", pa.string())]))


def latest(df: DataFrame) -> DataFrame:
    """id and content of the latest row of every id that has a content."""
    key = F.struct(F.col("update_time"), F.length("content"), F.col("content"))
    return df.filter("trim(content) <> ''").groupBy("id").agg(F.max_by("content", key).alias("content"))


_STATE: dict = {}


def read_pages(docs: DataFrame, furniture: Shared) -> DataFrame:
    """document_words() of all documents. A word at line -n is what the halves around the end of line n make joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _STATE.get("key") != furniture.key:
            _STATE.update(key=furniture.key, furniture=furniture.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                contents = part.column(1).to_pylist()
                kinds = _STATE["furniture"].read(contents)
                read = [document_words(c.split("\n"), k) for c, k in zip(contents, kinds)]
                ends = pa.array(np.cumsum([0, *(len(r[0]) for r in read)]), pa.int32())
                words = pa.ListArray.from_arrays(ends, pa.array([w for r in read for w in r[0]], pa.string()))
                at = pa.ListArray.from_arrays(ends, pa.array([n for r in read for n in r[1]], pa.int32()))
                pairs = pa.array([[dict(zip(("line", "next", "left", "right", "sign"), p)) for p in r[2]] for r in read], _PAIRS)
                lines = pa.array([[{"line": i, "kind": k} for i, k in r[3]] for r in read], _FURNITURE)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([k is not None for k in kinds]), words, at, pairs, lines], names=["id", "scan", "words", "at", "pairs", "furniture"]
                )

    return docs.select("id", "content").mapInArrow(run, ROWS)


def lexicon(rows: DataFrame) -> DataFrame:
    """word, n_clean, n_scan: how often clean texts and scans have it (joined halves count for scans)."""
    return (
        rows.select("scan", F.explode("words").alias("word")).groupBy("word")
        .agg(F.count_if(~F.col("scan")).alias("n_clean"), F.count_if("scan").alias("n_scan"))
    )


def all_grams(column: Column) -> Column:
    """The q-grams of the edged, folded word in order."""
    edged = F.concat(F.lit("^"), F.translate(column, "0156@†¢ſ|!89", "olsbatcfllbg"), F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.length(edged) - GRAM + 1), lambda i: F.substring(edged, i, F.lit(GRAM)))


def grams_of(column: Column) -> Column:
    return F.array_distinct(all_grams(column))


def candidate_pairs(words: DataFrame, trusted: DataFrame) -> DataFrame:
    """word and cand: each word with the trusted words that may be within EDITS edits of its folded form.

    Of two such words one of the PREFIX rarest grams of each is the same occurrence, at most
    EDITS places further on, whatever the order of rarity; all but EDITS * GRAM of their
    grams are shared. Keys are a gram and the candidate's length, so that a frequent gram is
    many keys.
    """
    right = cut(trusted.select(F.col("word").alias("cand"), grams_of(F.col("word")).alias("cand_grams")))
    rarity = right.select(F.explode("cand_grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    left = words.select("word", grams_of(F.col("word")).alias("grams"))

    def prefixed(df: DataFrame, name: str, column: Column) -> DataFrame:
        each = df.select(name, F.posexplode(all_grams(column)).alias("pos", "gram")).join(rarity, "gram", "left")
        ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram", "pos")))
        first = each.groupBy(name).agg(ordered.alias("g"))
        last = F.get("g", F.least(F.size("g"), F.lit(PREFIX)) - 1)
        kept = F.filter("g", lambda x: F.struct(x.n, x.gram) <= F.struct(last.n, last.gram))
        return first.select(name, F.explode(kept).alias("x")).select(name, F.col("x.gram").alias("gram"), F.col("x.pos").alias(f"{name}_at"))

    lengths = F.sequence(F.length("word") - EDITS, F.length("word") + EDITS)
    met = (
        prefixed(left, "word", F.col("word")).withColumn("size", F.explode(lengths))
        .join(prefixed(right, "cand", F.col("cand")).withColumn("size", F.length("cand")), ["gram", "size"])
        .filter((F.abs(F.col("word_at") - F.col("cand_at")) <= EDITS) & (F.col("word") != F.col("cand")))
        .select("word", "cand").distinct()
    )
    shared = F.size(F.array_intersect("grams", "cand_grams"))
    most = F.greatest(F.size("grams"), F.size("cand_grams"))
    return met.join(left, "word").join(right, "cand").filter((shared >= most - EDITS * GRAM) & (shared >= 1)).select("word", "cand")


_COSTS = {(good, bad): 0.25 for good, bads in MISREAD.items() for bad in bads}
_COSTS |= {(bad, good): 0.6 for (good, bad) in list(_COSTS) if (bad, good) not in _COSTS}
_MAX_SIDE = 2


def alignment(good: str, bad: str) -> tuple[float, int, int, int]:
    """Least cost of reading `bad` for `good`: cost, known misreadings, other edits, first place that differs."""
    n, m = len(good), len(bad)
    best = [[(9e9, 0, 0, 99)] * (m + 1) for _ in range(n + 1)]
    best[0][0] = (0.0, 0, 0, 99)
    for i in range(n + 1):
        for j in range(max(0, i - 3), min(m, i + 3) + 1):
            cost, known, other, place = best[i][j]
            if cost > 4:
                continue
            steps = []
            if i < n and j < m:
                if good[i] == bad[j]:
                    steps.append((1, 1, 0.0, 0, 0))
                else:
                    steps.append((1, 1, 1.0, 0, 1))
            for a in range(1, _MAX_SIDE + 1):
                for b in range(1, _MAX_SIDE + 1):
                    if i + a <= n and j + b <= m:
                        c = _COSTS.get((good[i : i + a], bad[j : j + b]))
                        if c is not None:
                            steps.append((a, b, c, 1, 0))
            if i + 1 < n and j + 1 < m and good[i] == bad[j + 1] and good[i + 1] == bad[j]:
                steps.append((2, 2, 1.0, 0, 1))
            if i < n:
                steps.append((1, 0, 1.0, 0, 1))
            if j < m:
                steps.append((0, 1, 1.0, 0, 1))
            for a, b, c, k, o in steps:
                new = (cost + c, known + k, other + o, min(place, j) if c else place)
                if new < best[i + a][j + b]:
                    best[i + a][j + b] = new
    return best[n][m]


def pair_features(word: str, cand: str, n_word: int, clean: int, scan: int) -> tuple:
    cost, known, other, _ = alignment(cand, word)
    low, total = len(word), clean + scan
    return (
        cost, known, other, low, odd(word), np.log1p(total), np.log1p(n_word), np.log1p(total) - np.log1p(n_word), np.log1p(clean),
        cost / low, word[0] != cand[0], word[-1:] != cand[-1:], len(cand) - low, n_word / (total + 1.0),
    )


def scored_pairs(pairs: DataFrame) -> DataFrame:
    """Adds the features as an array; pairs have word, cand, n_word, clean, scan."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["x"] = [list(map(float, pair_features(*r))) for r in zip(batch["word"], batch["cand"], batch["n_word"], batch["clean"], batch["scan"])]
            yield batch

    return pairs.mapInPandas(run, "word string, cand string, n_word bigint, source string, clean bigint, scan bigint, x array<double>")


def training_words(words: DataFrame, most: int, seed: int = 3) -> pd.DataFrame:
    """word, n_word, source: words misread on purpose with their source, and clean words without one."""
    real = words.filter("n_clean > 0 AND length(word) >= 3 AND word RLIKE '^[\\\\p{L}]+$'")
    # Few words are frequent and most of what is misread are these, so both kinds are drawn.
    frequent = real.orderBy(F.desc("n_clean"), "word").limit(most // 4).toPandas()
    some = real.orderBy(F.xxhash64("word")).limit(most // 2).toPandas()
    rng = np.random.default_rng(seed)
    rows, used = [], set(frequent["word"]) | set(some["word"])
    for word, clean, scan in pd.concat([frequent, frequent, some]).itertuples(index=False):
        bad = word
        while bad == word:
            share = 1.5 / len(word)
            bad = misread(word, rng, share)
            if bad == word and rng.random() < 0.3:
                break
        if bad != word and bad not in used:
            used.add(bad)
            rows.append((bad.lower(), int(1 + rng.poisson(0.004 * (clean + scan))), word))
    # Real words have no correction, be they rare or frequent.
    rows += [(w, int(s) + 1, None) for w, _, s in pd.concat([some, frequent]).itertuples(index=False)]
    return pd.DataFrame(rows, columns=["word", "n_word", "source"]).drop_duplicates("word")


def corrections(words: DataFrame, sample_words: int) -> DataFrame:
    """word, right, p: the misread words of scans and what they are read for."""
    spark = words.sparkSession
    schema = "word string, n_word bigint, source string"
    made = training_words(words, sample_words)
    trusted = words.filter("length(word) >= 3 AND word NOT RLIKE '[0-9†¢ſ@!|]' AND (n_clean > 0 OR n_scan >= 4)")
    suspects = words.filter("n_clean = 0 AND n_scan > 0 AND length(word) >= 2").select("word", F.col("n_scan").alias("n_word"), F.lit(None).cast("string").alias("source"))
    known = trusted.select(F.col("word").alias("cand"), F.col("n_clean").alias("clean"), F.col("n_scan").alias("scan"))

    def featured(rows: DataFrame) -> DataFrame:
        met = candidate_pairs(rows.select("word"), trusted).join(rows, "word").join(known, "cand")
        return scored_pairs(spread_rows(met.select("word", "cand", "n_word", "source", "clean", "scan")))

    ranker = None
    if len(made) and made["source"].notna().any():
        learn = featured(spark.createDataFrame(made, schema)).orderBy(F.coalesce(F.col("source") == F.col("cand"), F.lit(False)).desc(), F.xxhash64("word", "cand"))
        learn = learn.limit(LEARN_PAIRS).toPandas()
        y = (learn["source"] == learn["cand"]).to_numpy()
        if y.any() and not y.all():
            ranker = Boosted(60, 4).fit(np.stack(learn["x"].to_numpy()), y)
    flagged = suspects.select("word", F.lit(None).cast("string").alias("right"), F.lit(1.0).alias("p"))
    is_odd = F.pandas_udf(_odd, "boolean")
    flagged = flagged.filter("word RLIKE '[0-9†¢ſ@!|]'").filter(is_odd("word"))
    if ranker is None:
        return flagged
    shared = Shared(spark, ranker)

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"word": batch["word"], "right": batch["cand"], "p": shared.value.predict(np.stack(batch["x"].to_numpy()))})

    ranked = featured(suspects).mapInPandas(rank, "word string, right string, p double")
    best = ranked.groupBy("word").agg(F.max_by("right", F.struct("p", "right")).alias("right"), F.max("p").alias("p")).filter("p > 0.5")
    return best.unionByName(flagged.join(best.select("word"), "word", "left_anti"))


def spread_rows(df: DataFrame) -> DataFrame:
    """Deals rows out for Python work after a shuffle that may have left few partitions."""
    from lodestack.session import cores

    return df.repartition(max(3 * cores(df.sparkSession), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


ROLES = ("joined", "compound", "left", "right")


def hyphen_features(left: str, right: str, sign: str, counts: dict) -> list[float]:
    def count(role: str) -> tuple[float, float]:
        clean, scan = counts.get(role, (0, 0))
        return float(np.log1p(clean)), float(np.log1p(scan))

    vowels = "aeiouyáéíóúàèìòùâêîôûäöüë"
    return [
        *count("joined"), *count("compound"), *count("left"), *count("right"), HYPHENS.index(sign), len(left), len(right),
        right[:1].islower(), right[:1].isdigit(), left.isupper() and len(left) > 1, any(c.isdigit() for c in left),
        any(c in vowels for c in left.lower()), any(c in vowels for c in right.lower()), "-" in left or "-" in right,
    ]


def with_counts(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """pairs (key, left, right, sign, ...) with the counts of their four words, as a map by role."""
    l, r = F.lower("left"), F.lower("right")
    asked = pairs.select("key", F.explode(F.array(
        *[F.struct(F.lit(role).alias("role"), w.alias("word")) for role, w in zip(ROLES, (F.concat(l, r), F.concat_ws("-", l, r), l, r))]
    )).alias("x")).select("key", "x.role", "x.word")
    met = asked.join(words, "word").groupBy("key").agg(F.collect_list(F.struct("role", "n_clean", "n_scan")).alias("counts"))
    return pairs.join(met, "key", "left")


def hyphens(pairs: DataFrame, words: DataFrame, sample_words: int, seed: int = 4) -> DataFrame:
    """key of the pairs that are one word divided by the line break alone."""
    spark = words.sparkSession
    rng = np.random.default_rng(seed)
    real = words.filter("n_clean > 0 AND word RLIKE '^[\\\\p{L}]{5,}$'").orderBy(F.xxhash64("word")).limit(sample_words // 2).toPandas()
    often = words.filter("n_clean > 0 AND word RLIKE '^[\\\\p{L}]{5,}$'").orderBy(F.desc("n_clean"), "word").limit(sample_words // 4).toPandas()
    bound = words.filter("n_clean > 0 AND word RLIKE '^[\\\\p{L}]{2,}-[\\\\p{L}]{2,}$'").orderBy(F.desc("n_clean"), "word").limit(sample_words // 4).toPandas()
    made = []
    for w in [*real["word"], *often["word"], *often["word"]]:
        at = int(rng.integers(2, len(w) - 1))
        cased = w.capitalize() if rng.random() < 0.3 else w
        made.append((cased[:at], cased[at:], HYPHENS[rng.integers(len(HYPHENS))], 1))
    for w in list(bound["word"]) * max(1, min(40, len(made) // max(1, 3 * len(bound)))):
        a, b = w.split("-")[:2]
        made.append((a.capitalize() if rng.random() < 0.2 else a, b, HYPHENS[rng.integers(len(HYPHENS))], 0))
    for _ in range(len(made) // 10):
        code = "".join(rng.choice(list("ABCDEGKMQRTVX"), 2))
        made.append((code, f"{rng.integers(0, 10**7):07d}", HYPHENS[0], 0))
    if len(bound) == 0:
        made += [(a, b, "-", 0) for a, b in zip(often["word"], often["word"][::-1])]
    if not any(m[3] == 0 for m in made) or not any(m[3] == 1 for m in made):
        return pairs.filter(F.lower(F.substring("right", 1, 1)) == F.substring("right", 1, 1)).select("key")
    rows = pd.DataFrame([(str(i), *m) for i, m in enumerate(made)], columns=["key", "left", "right", "sign", "label"])
    learn = with_counts(spark.createDataFrame(rows), words).toPandas()

    def features(left, right, sign, counts, joined_left_out: bool = False):
        given = {c["role"]: (c["n_clean"], c["n_scan"]) for c in counts} if counts is not None else {}
        if joined_left_out:
            given.pop("joined", None)
        return hyphen_features(left, right, sign, given)

    # Every second rare word is shown as if the corpus had it nowhere else, like most names.
    x = [features(*r[1:5], joined_left_out=r[0] % 4 == 0) for r in zip(range(len(learn)), learn["left"], learn["right"], learn["sign"], learn["counts"])]
    model = Shared(spark, Boosted(50, 4).fit(np.array(x, float), learn["label"].to_numpy()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = [features(*r) for r in zip(batch["left"], batch["right"], batch["sign"], batch["counts"])]
                yield batch.loc[model.value.predict(np.array(x, float)) > 0.5, ["key"]]

    return with_counts(pairs, words).select("key", "left", "right", "sign", "counts").mapInPandas(run, "key string")


class Found:
    """What repair() needs: the documents with whether they are scans, line kinds, and corrections by line."""

    def __init__(self, docs: DataFrame, lines: DataFrame, fixes: DataFrame):
        self.docs, self.lines, self.fixes = docs, lines, fixes


def analyse(df: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_words: int = SAMPLE_WORDS) -> Found:
    """Line kinds (id, line_no, kind) and corrections (id, line_no, word, right) of a table of contents."""
    spark = df.sparkSession
    docs = spread(df.select("id", "content", "update_time"))
    docs = cut(latest(docs))
    sample = docs.orderBy(F.xxhash64("id")).limit(sample_docs).toPandas()
    paragraphs = paragraphs_of(sample["content"].tolist())
    if not paragraphs:
        empty = spark.createDataFrame([], "id string, line_no bigint, kind string")
        return Found(docs.withColumn("scan", F.lit(False)), empty, spark.createDataFrame([], "id string, line_no bigint, word string, right string"))
    rows = cut(read_pages(spread(docs), Shared(spark, Furniture(paragraphs))))
    words = cut(lexicon(rows))
    wrong = cut(corrections(words, sample_words))
    scans = rows.filter("scan")
    pairs = scans.select("id", F.inline("pairs")).select(F.concat_ws("|", "id", "line").alias("key"), "*")
    joined = cut(pairs.join(hyphens(pairs, words, sample_words), "key", "left_semi"))
    kept = pairs.join(joined.select("key"), "key", "left_anti")

    furniture = scans.select("id", F.inline("furniture"))
    # A misread word is rare, so the words of scans stay where they are if all misread words can be broadcast.
    in_lines = scans.select("id", F.inline(F.arrays_zip(F.col("at").alias("line"), F.col("words").alias("word")))).filter("line > 0")
    halves = kept.select("id", "line", F.lower("left").alias("word"))
    fixes = in_lines.unionByName(halves).join(wrong, "word").select("id", "line", "word", "right")
    place = F.pandas_udf(_place, "int")
    split_fixes = joined.select("id", "line", "next", F.lower(F.concat("left", "right")).alias("word"), F.length("left").alias("n")).join(wrong, "word")
    # A joined word's misread character may stand in the second half, on the next line of text.
    at_line = F.when(place("right", "word") >= F.col("n"), F.col("next")).otherwise(F.col("line"))
    split_fixes = split_fixes.select("id", "line", at_line.alias("at_line"), "word", "right")
    lines = (
        furniture.unionByName(joined.select("id", "line", F.lit("hyphen").alias("kind")))
        .unionByName(fixes.select("id", "line", F.lit("misread").alias("kind")))
        .unionByName(split_fixes.select("id", F.col("at_line").alias("line"), F.lit("misread").alias("kind"))).distinct()
    )
    all_fixes = fixes.unionByName(split_fixes.select("id", "line", "word", "right")).filter("right IS NOT NULL")
    name = F.col("line").cast("bigint").alias("line_no")
    docs = docs.join(rows.select("id", "scan"), "id")
    return Found(docs, lines.select("id", name, "kind"), all_fixes.select("id", name, "word", "right").distinct())


def _odd(words: pd.Series) -> pd.Series:
    return words.map(odd)


def _place(right: pd.Series, word: pd.Series) -> pd.Series:
    """Where a misread word first differs from its correction; 0 if it has none."""
    return pd.Series([alignment(a, b)[3] if a else 0 for a, b in zip(right, word)], dtype="int32")


def repaired(found: Found) -> DataFrame:
    """id and text: continuous paragraphs without running lines, divided and misread words."""
    lines = found.lines.groupBy("id").agg(F.collect_list(F.struct("line_no", "kind")).alias("lines"))
    fixes = found.fixes.groupBy("id").agg(F.collect_list(F.struct("line_no", "word", "right")).alias("fixes"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [
                repair(c, _rows(a), _rows(b)) if scan else c.replace("\r\n", "\n")
                for c, scan, a, b in zip(batch["content"], batch["scan"], batch["lines"], batch["fixes"])
            ]
            yield pd.DataFrame({"id": batch["id"], "text": out})

    return spread_rows(found.docs.join(lines, "id", "left").join(fixes, "id", "left")).mapInPandas(run, "id string, text string")


def _rows(value) -> list:
    return [] if value is None else list(value)


def replaced(line: str, word: str, right: str) -> str:
    def put(m: re.Match) -> str:
        old = m[0]
        return right.upper() if old.isupper() and len(old) > 1 else right.capitalize() if old[0].isupper() else right

    return re.sub(rf"(?<!\w){re.escape(word)}(?!\w)", put, line, flags=re.I)


def repair(content: str, lines: list, fixes: list) -> str:
    """The text of one scan with its furniture removed, hyphens joined and words replaced."""
    kinds: dict[int, set] = {}
    for x in lines:
        kinds.setdefault(x["line_no"], set()).add(x["kind"])
    right: dict[int, list] = {}
    for x in fixes:
        right.setdefault(x["line_no"], []).append((x["word"], x["right"]))
    words = {w: r for pairs in right.values() for w, r in pairs}
    paragraphs, current, glue = [], "", False
    usual = float(np.median([len(s) for s in content.split("\n") if s.strip()] or [0]))
    short_before = False
    for i, raw in enumerate(content.split("\n"), 1):
        line = raw.replace("\x0c", "").rstrip()
        have = kinds.get(i, set())
        if have & {"header", "page_number"}:
            continue
        starts = not line.strip() or raw[:2] == "  " or re.match(r"\s*(?:#|\d+(?:\.\d+)+\s|[-*•]\s|\|)", line) or _NUMERIC.match(line.replace(" ", "") or "x")
        if (starts or short_before) and not glue:
            if current:
                paragraphs.append(current)
            current = ""
        for w, r in right.get(i, ()):
            line = replaced(line, w, r)
        text = " ".join(line.split())
        short_before = bool(text) and len(line) < 0.7 * usual and text[-1] not in HYPHENS and text[-1] in ".!?:"
        if "hyphen" in have:
            text = text[:-1]
        current = current + text if glue else (f"{current} {text}".strip() if text else current)
        if glue and text:
            last = current.split()
            for k in range(len(last)):
                w = last[k].strip(_OUTER).lower()
                if w in words:
                    last[k] = replaced(last[k], w, words[w])
            current = " ".join(last)
        glue = "hyphen" in have or (glue and not text)
    if current:
        paragraphs.append(current)
    return "\n".join(paragraphs)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p4_found: lines of scanned documents that hold a running line, page number, divided or misread word."""
    return analyse(table(spark, sf_dir, "ekr_doc_full")).lines


def p4_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p4_text: every document's text as continuous, repaired paragraphs."""
    return repaired(analyse(table(spark, sf_dir, "ekr_doc_full")))


QUERIES = {"p4_found": p4_found, "p4_text": p4_text}
ORACLES: dict[str, str] = {}
