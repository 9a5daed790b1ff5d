"""Broken prompt and response pairs (problem 5).

A response is flagged with the first of these defects that it has:

* ``empty``: nothing remains without blanks, markers and fillers;
* ``refusal``: a sentence declines the request, by the model of refusals.py;
* ``echo``: every sentence stands in the prompt;
* ``language``: its language differs from the one the prompt asks for or is written in.
  Languages have posteriors by naive Bayes over character n-grams of the words that begin
  with a small letter, so that names don't count (in scripts without small letters all
  words count, in those without spaces all characters); nor do references, keyword lists,
  and all fields of a record but its last. The model is fitted on all prompts that their
  script or their function words name;
* ``truncated``: brackets or fences stay open, records lack their closing marker, or the
  last characters are unlikely to end a line of its kind. That likelihood comes from the
  n-grams of all responses: how often each ends a line, against how often it occurs.

All models are fitted on all rows: words, sentences and n-grams are counted in tasks, and
the driver gets tables of bounded size. That of line ends has a number of bins that follows
from the distinct n-grams of all responses, at most MOST_BINS.

Defined cases: a null response is empty; a null prompt can't be echoed and asks for no
language; responses of fewer than MIN_WORDS words have no language; repeated rows are
flagged once; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.refusals import Refusals
from lodestack.session import Shared, cores, cut, spread, table

MIN_WORDS = 4
# Rows for which the bounds of single counts are meant; for more, counts are divided.
USUAL_ROWS = 6000
MOST_COUNTED = 200_000
MARGIN = 4.0
LEAST_END = 0.12
LEAST_BINS, MOST_BINS = 1 << 14, 1 << 19

# Function words that name a text's language.
FUNCTION_WORDS = {
    "en": "the of and was were with has been is are to in by for that from this not at on which how what why",
    "fr": "le la les de des du et est été une un dans pour que avec sur au par plus qui nous pas selon comment pourquoi",
    "de": "der die das und ist wurde von hat den dem ein eine nicht mit auf zu im für als wie warum sie wenn nach",
    "es": "el los las del y fue una un en para que con por se al según no es más cuando qué cómo hay sobre",
    "it": "il lo gli di e è stata una un nel per che con su della dei non più come perché sono alla",
    "pt": "o os as do da e foi uma um em para que com por se ao não mais quando como são pelo dos",
    "nl": "de het een en is werd van heeft den niet met op te voor als hoe waarom wij wanneer naar zijn",
}
# Names of languages in prompts that ask for one.
LANGUAGE_NAMES = {
    "en": "english anglais englisch inglés inglese engels inglês", "fr": "french français französisch francés francese frans francês",
    "de": "german allemand deutsch alemán tedesco duits alemão", "es": "spanish espagnol spanisch español spagnolo spaans espanhol",
    "it": "italian italien italienisch italiano italiaans", "pt": "portuguese portugais portugiesisch portugués português portoghese portugees",
    "nl": "dutch néerlandais niederländisch neerlandés holandés olandese nederlands",
}
# Responses that say nothing.
FILLERS = frozenset(
    "n/a na null none nil nan undefined empty tbd todo - -- --- . .. ... … ? {} [] () \"\" '' answer response output result "
    "antwort réponse respuesta resultado ergebnis résultat ok".split()
) | {"no answer", "no response", "keine antwort", "sin respuesta", "pas de réponse", "no output", "no content"}
MARKERS = re.compile(r"<\|(?!#\|>)[^|<>]{0,40}\|>|```\w*|</?s>|\[(?:END|DONE|EOS)\]")
BLANK = re.compile(r"[\s​‌‍⁠﻿­]+")
REFERENCE_HEADS = frozenset("references sources reference source quellen références sources referencias fuentes bibliography literatur".split())
# Verbs of prompts that ask for an answer.
ANSWER_VERBS = frozenset(
    "answer respond reply write translate explain summarise summarize describe réponds répondez répondre écris écrivez rédigez traduis traduisez "
    "antworte antworten schreibe schreib übersetze responde responda contesta escribe escriba traduce rispondi rispondere scrivi traduci responda escreva "
    "antwoord schrijf vertaal".split()
)
LEAD_IN = re.compile(r"^[\s>\"'*]*(?:(?:q|a|question|answer|response|frage|antwort|réponse|pregunta|respuesta)\s*:\s*)+", re.I)
OPEN_END = re.compile(r"(?:…|\.\.\.|[\[({<,;:–-]|<\||\|)\s*$")


def body_of(response: str | None) -> tuple[str, bool]:
    """The response without markers and outer blanks, and whether it ended with a marker."""
    text = response or ""
    tail = text.rstrip()
    closed = bool(re.search(r"(?:<\|(?!#\|>)[^|<>]{0,40}\|>|\[(?:END|DONE|EOS)\])$", tail))
    return MARKERS.sub(" ", text).strip(" \t\r\n​‌‍⁠﻿"), closed


def is_empty(body: str) -> bool:
    plain = BLANK.sub(" ", body).strip().lower().rstrip(" :.")
    if not plain or plain in FILLERS or not any(c.isalnum() for c in plain):
        return True
    if plain[0] in "{[":
        try:
            return not any(_leaves(json.loads(body)))
        except ValueError:
            return False
    return False


def _leaves(value):
    if isinstance(value, dict):
        value = list(value.values())
    if isinstance(value, list):
        for x in value:
            yield from _leaves(x)
    elif value not in (None, "", False):
        yield value


def sentences(text: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.!?])\s+|\n+|<\|#\|>", text) if s.strip()]


def squeezed(text: str) -> str:
    return " ".join(re.findall(r"\w+", text.lower()))


def echoes(body: str, prompt: str | None) -> bool:
    """Whether all of the body stands in the prompt. Up to four words count only as a whole line of it."""
    if not prompt:
        return False
    body = LEAD_IN.sub("", body)
    said = squeezed(body)
    if not said:
        return False
    if len(said.split()) < 5:
        lines = {squeezed(x) for line in prompt.split("\n") for x in (line, line.split(":", 1)[-1])}
        return said in lines
    given = f" {squeezed(prompt)}"
    return all(f" {squeezed(s)}" in given for s in sentences(body) if squeezed(s))


def prose_of(text: str, prompt: str = "") -> str:
    """What counts for the language: no references, keywords, names of records, nor the repeated question."""
    if re.match(r"\s*(?:```\w*\s*)?[{\[]", text):
        return ""
    out, given = [], f" {squeezed(prompt)} "
    for line in text.split("\n"):
        bare = line.strip().strip("#*: ").lower()
        if re.match(r"\s*[-*]?\s*\[\d+\]", line) or bare in REFERENCE_HEADS:
            continue
        if "<|#|>" in line:
            line = line.rsplit("<|#|>", 1)[1]
        elif prompt and bare.endswith("?") and f" {squeezed(line)} " in given:
            continue
        out.append(line)
    return "\n".join(out)


# Unicode ranges of scripts that tell a language or stand for it.
SCRIPTS = (
    ("ja", "\u3040-\u30ff"), ("zh", "\u3400-\u4dbf\u4e00-\u9fff"), ("ko", "\uac00-\ud7af\u1100-\u11ff"), ("cyrillic", "\u0400-\u04ff"), ("arabic", "\u0600-\u06ff"),
    ("he", "\u0590-\u05ff"), ("el", "\u0370-\u03ff"), ("devanagari", "\u0900-\u097f"), ("th", "\u0e00-\u0e7f"),
)
_SCRIPT = {name: re.compile(f"[{span}]") for name, span in SCRIPTS}
_UNSPACED = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\u0e00-\u0e7f"
_LETTERS = re.compile(rf"[{_UNSPACED}]|[^\W\d_{_UNSPACED}]+(?:['’][^\W\d_{_UNSPACED}]+)?")


def small_words(text: str) -> list[str]:
    """The words that count for the language: without capital letters, single characters where words aren't spaced."""
    return [w.lower() for w in _LETTERS.findall(text) if not w[0].isupper()]


def script_of(text: str) -> str | None:
    """The script other than Latin that most letters are of; kana among Han characters make it Japanese."""
    if not text or max(text) < "\u0370":
        return None
    letters = sum(map(str.isalpha, text))
    counts = {name: len(pattern.findall(text)) for name, pattern in _SCRIPT.items()}
    if counts.get("ja", 0) * 10 >= counts.get("zh", 0) and counts.get("ja", 0):
        counts["ja"] += counts["zh"]
    name = max(counts, key=counts.get)
    return name if 2 * counts[name] > letters else None


def named_language(text: str) -> str | None:
    """The language of the text's script, or whose function words clearly prevail."""
    script = script_of(text)
    if script:
        return script
    counts = Counter(re.findall(r"[^\W\d_]+", text.lower()))
    scores = sorted(((sum(counts[w] for w in words.split()), lang) for lang, words in FUNCTION_WORDS.items()), reverse=True)
    return scores[0][1] if scores[0][0] >= 4 and scores[0][0] >= 1.5 * scores[1][0] else None


_ASKED = re.compile(r"\b(?:in|en|auf|em|op|im) (" + "|".join(n for names in LANGUAGE_NAMES.values() for n in names.split()) + r")\b")
_LANGUAGE_OF = {n: lang for lang, names in LANGUAGE_NAMES.items() for n in names.split()}


def asked_language(prompt: str) -> str | None:
    """The language that the prompt asks for: in a sentence that asks for an answer, or in its last one."""
    found = None
    low = prompt.lower()
    if not _ASKED.search(low):
        return None
    said = [x for x in re.split(r"(?<=[.!?:])\s+|\n+", low) if x.strip()]
    for i, sentence in enumerate(said):
        m = _ASKED.search(sentence)
        if m and (i + 1 == len(said) or ANSWER_VERBS.intersection(re.findall(r"\w+", sentence))):
            found = _LANGUAGE_OF[m[1]]
    return found


def word_grams(word: str) -> list[int]:
    edged = f" {word} "
    return [hash_text(edged[i : i + n]) for n in (1, 2, 3, 4) for i in range(len(edged) - n + 1)] + [hash_text("w" + edged)]


def hash_text(text: str) -> int:
    h = 2166136261
    for b in text.encode("utf-8", "surrogatepass"):
        h = ((h ^ b) * 16777619) & 0xFFFFFFFF
    return h & 0xFFFF


def grams_of(words: Iterable[tuple[str, int]], scale: float) -> np.ndarray:
    """Counts of the n-grams of words that occur so many times, at most 50 times scale of a word."""
    out = np.zeros(1 << 16, np.int64)
    for word, n in words:
        np.add.at(out, word_grams(word), min(n, round(50 * scale)))
    return out


def summed(batches: Iterable[Iterable[tuple]], names: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of how often each tuple occurs. One that occurs in several frames is to be summed; they only bound memory."""
    seen: Counter = Counter()

    def frame() -> pd.DataFrame:
        return pd.DataFrame({**{name: [k[i] for k in seen] for i, name in enumerate(names)}, "n": list(seen.values())})

    for batch in batches:
        for key in batch:
            seen[key] += 1
            if len(seen) >= MOST_COUNTED:
                yield frame()
                seen.clear()
    if seen:
        yield frame()


class Languages:
    """Naive Bayes over hashed character n-grams."""

    def __init__(self, texts: list[str], scale: float = 1.0):
        counts: dict[str, Counter] = {}
        for text in texts:
            lang = named_language(text)
            if lang:
                counts.setdefault(lang, Counter()).update(small_words(text))
        grams = {lang: grams_of(c.items(), scale) / scale for lang, c in counts.items()}
        self._fit({lang: sum(c.values()) for lang, c in counts.items()}, grams)

    @classmethod
    def fitted(cls, rows: DataFrame, column: str, scale: float = 1.0) -> Languages:
        """The model of all texts of a column. The driver gets as many counts as there are languages and bins."""

        def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            yield from summed((((lang, w) for text in batch[column] if (lang := named_language(text)) for w in small_words(text)) for batch in batches), ["lang", "word"])

        def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own: dict[str, np.ndarray] = {}
            many: Counter = Counter()
            for batch in batches:
                for lang, part in batch.groupby("lang"):
                    own[lang] = own.get(lang, 0) + grams_of(zip(part["word"], part["n"]), scale)
                    many[lang] += int(part["n"].sum())
            for lang, found in own.items():
                at = np.flatnonzero(found)
                yield pd.DataFrame({"lang": lang, "bin": [-1, *at], "n": [many[lang], *found[at]]})

        counts = rows.filter(F.col(column).isNotNull()).select(column).mapInPandas(words, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
        found = counts.mapInPandas(grams, "lang string, bin int, n bigint").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
        totals, tables = {}, {}
        for lang, part in found.groupby("lang"):
            many = part["bin"] < 0
            totals[lang], tables[lang] = int(part["n"][many].sum()), np.zeros(1 << 16, np.int64)
            tables[lang][part["bin"][~many]] = part["n"][~many]
        new = cls.__new__(cls)
        new._fit(totals, {lang: x / scale for lang, x in tables.items()})
        return new

    def _fit(self, totals: dict[str, int], grams: dict[str, np.ndarray]) -> None:
        """Of how many words each language has, and the counts of its n-grams."""
        self.names = sorted(k for k, n in totals.items() if n >= max(50, 0.002 * sum(totals.values())))
        table_ = np.full((max(1, len(self.names)), 1 << 16), 0.05)
        for row, lang in enumerate(self.names):
            table_[row] += grams[lang]
        self.log = np.log(table_ / table_.sum(1, keepdims=True)).astype(np.float32)
        self.memo: dict[str, np.ndarray] = {}

    def scores(self, text: str) -> tuple[int, np.ndarray]:
        """Number of words that count, and the log-likelihood of each language, a word counting as one observation."""
        words = small_words(text)
        if len(self.memo) > 100_000:
            self.memo.clear()
        for w in words:
            if w not in self.memo:
                grams = word_grams(w)
                self.memo[w] = self.log[:, grams].mean(1) * 4
        return len(words), np.array([self.memo[w] for w in words], np.float64).reshape(len(words), -1).sum(0) if words else np.zeros(len(self.names))

    def differs(self, prompt: str, response: str) -> bool:
        """Whether the response is in another language than the prompt asks for."""
        prose, asked = prose_of(response, prompt), asked_language(prompt)
        # Another script needs no model.
        if script_of(prose) != (None if asked else script_of(prompt)) and min(len(small_words(prose)), len(small_words(prompt))) >= MIN_WORDS:
            return True
        if len(self.names) < 2:
            return False
        n, got = self.scores(prose)
        if n < MIN_WORDS:
            return False
        if asked in self.names:
            want = self.names.index(asked)
        else:
            m, own = self.scores(prompt)
            if m < MIN_WORDS:
                return False
            want = int(own.argmax())
        best = int(got.argmax())
        return best != want and got[best] - got[want] > MARGIN


def last_line(body: str) -> tuple[str, str]:
    """The last line and its kind: ref, bullet, prose or phrase."""
    line = body.rstrip().rsplit("\n", 1)[-1].strip()
    if "<|#|>" in line:
        line = line.rsplit("<|#|>", 1)[1]
    return line, line_kind(line)


def line_kind(line: str) -> str:
    if re.match(r"\s*[-*]?\s*\[\d+\]", line):
        return "ref"
    if re.match(r"\s*(?:[-*•]|\d+[.)])\s", line):
        return "bullet"
    return "prose" if len(line.split()) >= 6 or re.search(r"[.!?]$", line) else "phrase"


KINDS = ("prose", "phrase", "bullet", "ref")
SIZES = {"prose": (1, 2), "phrase": (1, 2, 4), "bullet": (1, 2, 4, 6), "ref": (1, 2, 4, 6)}


def gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n bytes that end at each place from n - 1 on."""
    if len(data) < n:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(data) - n + 1, np.uint64)
    for k in range(n):
        h = h * np.uint64(1000003) + data[k : len(data) - n + 1 + k].astype(np.uint64) + np.uint64(1)
    return h * np.uint64(0x9E3779B97F4A7C15)


def gram_bins(data: np.ndarray, n: int, bins: int) -> np.ndarray:
    """The bin, of a power of two of them, of each place's n bytes."""
    return (gram_hashes(data, n) >> np.uint64(65 - bins.bit_length())).astype(np.int64)


def bins_for(rows: DataFrame, column: str) -> int:
    """Bins for four times the distinct 6-byte n-grams of all responses, between the bounds.

    A task that has met more of them than the most bins are for says so instead of sending them.
    """
    most = MOST_BINS // 4

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(0, np.uint64)
        for batch in batches:
            for at in range(0, len(batch), 200):
                if len(seen) <= most:
                    bodies = [body_of(t)[0].encode("utf-8", "replace") for t in batch[column].iloc[at : at + 200]]
                    seen = np.unique(np.concatenate([seen, *(gram_hashes(np.frombuffer(x, np.uint8), 6) for x in bodies)]))
        full = len(seen) > most
        yield pd.DataFrame({"gram": np.zeros(1, np.int64) if full else seen.view(np.int64), "full": full})

    found = rows.select(column).mapInPandas(run, "gram bigint, full boolean").distinct().agg(F.count(F.lit(1)).alias("n"), F.max("full").alias("full")).first()
    many = 4 * (most if found["full"] else found["n"])
    return min(MOST_BINS, max(LEAST_BINS, 1 << max(0, many - 1).bit_length()))


def sentence_counts(rows: DataFrame, column: str) -> DataFrame:
    """sentence and n: how often each sentence stands in the responses."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from summed((((s,) for text in batch[column] for s in sentences(body_of(text)[0])) for batch in batches), ["sentence"])

    # As many partitions as Python work needs, which adaptive execution would join.
    parts = max(3 * cores(rows.sparkSession), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.select(column).mapInPandas(run, "sentence string, n bigint").repartition(parts, "sentence").groupBy("sentence").agg(F.sum("n").alias("n"))


def end_counts(rows: DataFrame, column: str, bins: int) -> DataFrame:
    """How often each n-gram occurs in a line of each kind and how often it ends one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            lines: dict[str, list[bytes]] = {k: [] for k in KINDS}
            for text in batch[column]:
                body, _ = body_of(text)
                for line in body.split("\n"):
                    line = line.rsplit("<|#|>", 1)[-1].strip() if not line.startswith(("{", "[{")) else ""
                    if line:
                        lines[line_kind(line)].append(line.encode("utf-8", "replace"))
            for k, kind in enumerate(KINDS):
                data = np.frombuffer(b"\n".join(lines[kind]) + b"\n", np.uint8)
                ends = np.flatnonzero(data == 10) - 1
                for n in SIZES[kind]:
                    own = gram_bins(data, n, bins)
                    at = ends[ends >= n - 1] - (n - 1)
                    both = seen.setdefault((k, n), np.zeros((2, bins), np.int32))
                    both[0] += np.bincount(own, minlength=bins).astype(np.int32)
                    both[1] += np.bincount(own[at], minlength=bins).astype(np.int32)
        for (k, n), both in seen.items():
            at = np.flatnonzero(both[0])
            yield pd.DataFrame({"kind": k, "n": n, "bin": at, "seen": both[0][at], "ended": both[1][at]})

    return (
        rows.select(column).mapInPandas(run, "kind int, n int, bin int, seen bigint, ended bigint")
        .groupBy("kind", "n", "bin").agg(F.sum("seen").alias("seen"), F.sum("ended").alias("ended"))
    )


class Ends:
    """Likelihood that a line ends where it does. The table is bounded: kinds x sizes x bins."""

    def __init__(self, counts: pd.DataFrame, bins: int):
        self.bins = bins
        self.tables = {(KINDS[k], n): np.zeros((2, bins), np.float32) for k, kind in enumerate(KINDS) for n in SIZES[kind]}
        for (k, n), part in counts.groupby(["kind", "n"]):
            t = self.tables[KINDS[k], n]
            t[0][part["bin"]], t[1][part["bin"]] = part["seen"], part["ended"]

    def likelihood(self, line: str, kind: str) -> float:
        data, p = np.frombuffer(line.encode("utf-8", "replace"), np.uint8), 0.3
        for n in SIZES[kind]:
            if len(data) < n:
                break
            at = int(gram_bins(data[-n:], n, self.bins)[0])
            seen, ended = self.tables[kind, n][:, at]
            p = (ended + 3 * p) / (seen + 3)
        return float(p)


def unclosed(text: str) -> bool:
    """Whether brackets or quotes of a JSON text stay open."""
    depth, quoted, escaped = 0, False, False
    for c in text:
        if quoted:
            quoted = escaped or c != '"'
            escaped = c == "\\" and not escaped
        elif c == '"':
            quoted, escaped = True, False
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
    return quoted or depth > 0


def truncated(response: str, body: str, closed: bool, ends: Ends) -> bool:
    if re.match(r"\s*(?:```\w*\s*)?[{\[]\s*[\"\]}{\[]", response):
        return unclosed(body) or (response.lstrip().startswith("```") and not response.rstrip().endswith("```"))
    if "<|#|>" in body and not closed:
        return True
    if OPEN_END.search(body):
        return True
    line, kind = last_line(body)
    if line.lower().strip("#*: ") in REFERENCE_HEADS:
        return True
    return ends.likelihood(line, kind) < (LEAST_END if kind != "phrase" else LEAST_END / 6)


def defect_of(prompt: str | None, response: str | None, languages: Languages, ends: Ends, refusals: Refusals) -> str | None:
    body, closed = body_of(response)
    if is_empty(body):
        return "empty"
    if any(map(refusals.declines, sentences(body))):
        return "refusal"
    if echoes(body, prompt) and not OPEN_END.search(body):
        return "echo"
    if prompt and languages.differs(prompt, body):
        return "language"
    if truncated(response, body, closed, ends):
        return "truncated"
    return None


_STATE: dict = {}


def defects(rows: DataFrame, id_col: str, prompt_col: str, response_col: str) -> DataFrame:
    """id and defect of every defective pair."""
    rows = spread(rows.select(F.col(id_col).alias("id"), F.col(prompt_col).alias("prompt"), F.col(response_col).alias("response")))
    scale = max(1.0, rows.count() / USUAL_ROWS)
    refusals = Refusals.fitted(cut(sentence_counts(rows, "response")), scale=scale)
    languages, bins = Languages.fitted(rows, "prompt", scale), bins_for(rows, "response")
    models = Shared(rows.sparkSession, (languages, Ends(end_counts(rows, "response", bins).toPandas(), bins), refusals))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if _STATE.get("key") != models.key:
            _STATE.update(key=models.key, models=models.value)
        for batch in batches:
            found = [defect_of(p, r, *_STATE["models"]) for p, r in zip(batch["prompt"], batch["response"])]
            out = pd.DataFrame({"id": batch["id"], "defect": found})
            yield out[out["defect"].notna()]

    return rows.mapInPandas(run, "id string, defect string").distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p5_found: defective rows of the cache with their defect."""
    return defects(table(spark, sf_dir, "ekr_llm_cache"), "id", "original_prompt", "return_value")


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p5_rates: defective pairs per type of call and defect; a pair is told by workspace and id."""
    key = F.to_json(F.struct("workspace", "id", "cache_type"), {"ignoreNullFields": "false"})
    rows = table(spark, sf_dir, "ekr_llm_cache").withColumn("key", key)
    found = defects(rows, "key", "original_prompt", "return_value")
    kind = F.get_json_object("id", "$.cache_type").alias("cache_type")
    return found.groupBy(kind, "defect").agg(F.count(F.lit(1)).alias("n_pairs"))


QUERIES = {"p5_found": p5_found, "p5_rates": p5_rates}
ORACLES: dict[str, str] = {}
