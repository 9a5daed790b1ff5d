"""Variant spellings of persons and organisations (problem 1).

1. Every distinct token of the names is a word of a trie join: words are cut into three
   segments, of which one survives any single edit, and meet in the shard of a shared
   segment; each shard's words form a trie, which a Levenshtein automaton (with
   transpositions) of the other words traverses. A rare word within distance 1 of a
   better attested one is its misspelling, and so is a word of LONG_WORD or more letters
   within distance 2 (ph for f, two typos). Pairs of distance 2 meet by equal words after
   at most two deletions, or, if longer than MOST_DELETED, by one of five segments.
2. Words are put in their attested spelling, known abbreviations of organisations are
   written out, titles, articles and bracketed acronyms dropped.
3. Token order is settled by keys that are equal for every permutation of a name's words.
   Shortened names (initials, cut or familiar given names, acronyms) carry the keys that
   their full forms emit, and join the full form if exactly one has the key.

No block of names is compared pairwise; all matching is by equality of keys.

Words the lists lack are learnt: a short word stands for a longer one that it abbreviates by
its letters if both occur with the same other words in LEAST_CONTEXTS names, and no other
long word does so half as often.

Defined cases: null and blank names and names without letters take no part; a name with
digits only matches names with the same digits; a shortened name that fits several full
names joins none and is reported by ambiguous_names(); names of one spelling give no pairs;
repeated names count once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators.skew import lookup_join
from lodestack.session import cores, cut, spread, table

LEAST_CONTEXTS = 3
MIN_WORD = 4
LONG_WORD = 8
MOST_DELETED = 24

# Words of names.
TITLES = frozenset("prof dr eng mr mrs ms miss sir dame ir ing rev hon mag dipl phd".split())
ARTICLES = frozenset("the of for and a an de la le der die das und et y pour für".split()) - {"de", "la", "le"}
PARTICLES = frozenset("van von de del della di da dos du den ter ten la le".split())
ORG_WORDS = {
    "soc": "society", "socy": "society", "mus": "museum", "obs": "observatory", "obsy": "observatory", "inst": "institute",
    "found": "foundation", "fdn": "foundation", "fnd": "foundation", "lab": "laboratory", "labs": "laboratory",
    "univ": "university", "uni": "university", "u": "university", "dept": "department", "dep": "department",
    "natl": "national", "nat": "national", "cncl": "council", "coun": "council", "intl": "international",
    "int": "international", "bros": "brothers", "mfg": "manufacturing", "manuf": "manufacturing", "co": "company",
    "comp": "company", "auth": "authority", "res": "research", "tech": "technology", "technol": "technology",
    "engrg": "engineering", "engin": "engineering", "instr": "instruments", "edu": "education", "educ": "education",
    "assn": "association", "assoc": "association", "ctr": "centre", "center": "centre", "cent": "central",
    "comm": "commission", "cttee": "committee", "hosp": "hospital", "acad": "academy", "coll": "college", "sch": "school",
    "govt": "government", "min": "ministry", "fed": "federal", "conf": "conference", "hist": "history", "sci": "science",
    "stud": "studies", "cons": "conservation", "conserv": "conservation", "hydrol": "hydrology", "biol": "biology",
    "mech": "mechanics", "corp": "corporation", "grp": "group", "ind": "industries", "svc": "services", "svcs": "services",
}
LEGAL = {
    "ltd": "ltd", "limited": "ltd", "inc": "inc", "incorporated": "inc", "llc": "llc", "plc": "plc", "gmbh": "gmbh",
    "ag": "ag", "bv": "bv", "nv": "nv", "sa": "sa", "sarl": "sarl", "kg": "kg", "oy": "oy", "ab": "ab", "spa": "spa", "srl": "srl",
}
ORG_FULL = frozenset(ORG_WORDS.values()) | {"port", "instruments", "bank", "club", "union", "church", "library", "archive"}
FAMILIAR = {
    "alexander": "alex alec sandy sasha xander", "alexandra": "alex sandra sasha", "andrew": "andy drew", "anthony": "tony ant",
    "barbara": "barb babs", "benjamin": "ben benny benji", "catherine": "cathy kate kitty", "celeste": "celia", "charles": "charlie chuck chas",
    "christina": "tina chris", "christopher": "chris kit topher", "daniel": "dan danny", "david": "dave davy", "deborah": "debbie deb debby",
    "dorothy": "dot dottie dolly", "edward": "ed eddie ted ned", "elena": "lena nell", "elizabeth": "liz beth betty lizzie eliza lisa libby",
    "francisco": "paco pancho frank", "frederick": "fred freddie fritz", "gabriella": "gabi gaby ella", "giuseppe": "beppe peppe pino",
    "gregory": "greg", "helena": "lena nell", "henry": "hal harry hank", "ignacio": "nacho iggy", "isabella": "bella izzy isa", "jacqueline": "jackie jacqui",
    "james": "jim jimmy jamie", "johannes": "hans jan johan", "john": "jack johnny", "joseph": "joe joey", "josephine": "jo josie",
    "katherine": "kate kathy katie kitty kay", "leonard": "len lenny leo", "magdalena": "lena magda", "margaret": "maggie meg peggy marge",
    "matthew": "matt matty", "michael": "mike mick mickey", "nathaniel": "nat nate", "nicholas": "nick nicky", "patricia": "pat trish patty tricia",
    "patrick": "pat paddy", "peter": "pete", "philip": "phil", "rebecca": "becky becca", "richard": "dick rick ricky rich",
    "robert": "bob rob bobby bert", "ronald": "ron ronnie", "samuel": "sam sammy", "sebastian": "seb bastian basti", "stephen": "steve",
    "susan": "sue susie", "susannah": "sue susie", "theodore": "ted theo teddy", "thomas": "tom tommy", "timothy": "tim", "victoria": "vicky tori vicki",
    "vincent": "vince", "walter": "walt wally", "william": "bill will billy willy liam", "zachary": "zach zack zak",
}
GIVEN_BY_NICK: dict[str, list[str]] = {}
for _formal, _nicks in FAMILIAR.items():
    for _nick in _nicks.split():
        GIVEN_BY_NICK.setdefault(_nick, []).append(_formal)
SETTLED = TITLES | ARTICLES | PARTICLES | ORG_WORDS.keys() | LEGAL.keys() | ORG_FULL | FAMILIAR.keys() | GIVEN_BY_NICK.keys()


def fold(text: str) -> str:
    """Lower case without accents."""
    parts = unicodedata.normalize("NFKD", text)
    return "".join(c for c in parts if not unicodedata.combining(c)).casefold()


def tokens(name: str) -> list[tuple[str, str]]:
    """(token, kind) in order; kinds: comma, initial, acronym, cut, word, code."""
    name = re.sub(r"\(([^()]*)\)", " ", name)
    letters = [c for c in name if c.isalpha()]
    shouting = sum(c.isupper() for c in letters) > 0.6 * len(letters)
    out = []
    for raw in re.findall(r"[^\s,]+|,", name):
        if raw == ",":
            out.append((",", "comma"))
            continue
        if raw == "&":
            continue
        letters = re.sub(r"[^\w-]", "", fold(raw.replace("'", "").replace("’", ""))).strip("-_")
        if not letters:
            continue
        if any(c.isdigit() for c in letters):
            out.append((letters, "code"))
        elif letters in LEGAL:
            out.append((letters, "word"))
        elif re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]?\.?|[^\W\d_]", raw):
            out.extend((c, "initial") for c in letters)
        elif raw.isupper() and 2 <= len(raw) <= 6 and not shouting and letters not in ORG_WORDS:
            out.append((letters, "acronym"))
        elif raw.endswith(".") and letters not in TITLES:
            out.append((letters, "cut"))
        else:
            out.append((letters, "word"))
    return out


def automaton_step(states: frozenset, word: str, c: str, d: int) -> frozenset:
    """One step of the Levenshtein automaton of `word` with transpositions.

    A state is (letters of the word consumed, edits, whether a transposition is half done).
    """
    out = set()
    n = len(word)
    for i, e, half in states:
        if half:
            if word[i] == c:
                out.add((i + 2, e, False))
            continue
        if i < n and word[i] == c:
            out.add((i + 1, e, False))
        if e < d:
            out.add((i, e + 1, False))
            if i < n:
                out.add((i + 1, e + 1, False))
            for k in range(1, d - e + 1):
                if i + k < n and word[i + k] == c:
                    out.add((i + k + 1, e + k, False))
            if i + 1 < n and word[i + 1] == c:
                out.add((i, e + 1, True))
    return frozenset(out)


def accepts(states: frozenset, word: str, d: int) -> bool:
    return any(not half and len(word) - i + e <= d for i, e, half in states)


def build_trie(words: Iterator[tuple[str, int]]) -> dict:
    root: dict = {}
    for word, weight in words:
        node = root
        for c in word:
            node = node.setdefault(c, {})
        node[""] = (word, weight)
    return root


def neighbours(trie: dict, word: str, d: int = 1) -> list[tuple[str, int]]:
    """Words of the trie within distance d, with their weights."""
    found, stack = [], [(trie, frozenset({(0, 0, False)}))]
    while stack:
        node, states = stack.pop()
        if "" in node and accepts(states, word, d):
            found.append(node[""])
        for c, child in node.items():
            if c:
                after = automaton_step(states, word, c, d)
                if after:
                    stack.append((child, after))
    return found


def segments(n: int, d: int = 1) -> list[tuple[int, int]]:
    """2 d + 1 nearly equal spans of a word of n letters; d edits leave one of them whole."""
    ends = [n * i // (2 * d + 1) for i in range(2 * d + 2)]
    return list(zip(ends, ends[1:]))


def shard_keys(word: str, d: int = 1) -> tuple[list[str], list[str]]:
    """Keys under which a word is stored, and keys under which it looks for words not longer."""
    n = len(word)
    own = [f"{n}:{i}:{word[lo:hi]}" for i, (lo, hi) in enumerate(segments(n, d))]
    probes = {
        f"{m}:{i}:{word[lo + s : hi + s]}"
        for m in range(n - d, n + 1) if m >= MIN_WORD - 1
        for i, (lo, hi) in enumerate(segments(m, d)) for s in range(-d, d + 1) if lo + s >= 0 and hi + s <= n
    }
    return own, sorted(probes)


def deletions(word: str) -> set[str]:
    """What is left of a word after at most two deletions; words within distance 2 have one of these in common."""
    once = {word[:i] + word[i + 1 :] for i in range(len(word))}
    return {word} | once | {w[:i] + w[i + 1 :] for w in once for i in range(len(w))}


def words_of(names: DataFrame) -> DataFrame:
    """word and the number of names that have it, for the words that may be misspelt or attest others."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [w for name in batch["name"] for w in {t for t, kind in tokens(name) if kind == "word" and len(t) >= MIN_WORD - 1}]
            yield pd.DataFrame({"word": rows})

    return names.mapInPandas(run, "word string").groupBy("word").agg(F.count(F.lit(1)).alias("names"))


def trie_join(words: DataFrame, d: int = 1) -> DataFrame:
    """Pairs of different words within distance d, with the number of names of each."""

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for word, names in zip(batch["word"], batch["names"]):
                own, probes = shard_keys(word, d)
                rows += [(k, True, word, names) for k in own] + [(k, False, word, names) for k in probes]
            yield pd.DataFrame(rows, columns=["key", "stored", "word", "names"])

    def join(group: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, shard in group.groupby("key", sort=False):
            stored = shard[shard["stored"]]
            if len(stored) == 0:
                continue
            trie = build_trie(zip(stored["word"], stored["names"]))
            for word, names in zip(shard["word"][~shard["stored"]], shard["names"][~shard["stored"]]):
                rows += [(word, names, other, n) for other, n in neighbours(trie, word, d) if other != word]
        return pd.DataFrame(rows, columns=["a", "a_names", "b", "b_names"])

    keyed = words.mapInPandas(spell, "key string, stored boolean, word string, names bigint")
    shards = max(4 * cores(words.sparkSession), int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = keyed.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards * 16)))
    return keyed.groupBy("shard").applyInPandas(join, "a string, a_names bigint, b string, b_names bigint").distinct()


def deletion_join(words: DataFrame) -> DataFrame:
    """Pairs of different words within distance 2, with the number of names of each."""

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 2000):
                part = batch.iloc[lo : lo + 2000]
                rows = [(k, word, names) for word, names in zip(part["word"], part["names"]) for k in deletions(word)]
                yield pd.DataFrame(rows, columns=["key", "word", "names"])

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for met in batch["met"]:
                own = [(m["word"], m["names"]) for m in met]
                trie = build_trie(own)
                rows += [(word, names, other, n) for word, names in own for other, n in neighbours(trie, word, 2) if other < word]
            yield pd.DataFrame(rows, columns=["a", "a_names", "b", "b_names"])

    keyed = spread(words).mapInPandas(spell, "key string, word string, names bigint")
    met = keyed.groupBy("key").agg(F.collect_list(F.struct("word", "names")).alias("met")).filter(F.size("met") > 1)
    # Most pairs meet under many keys; only one group of each set of words is searched.
    met = met.select(F.array_sort("met").alias("met")).distinct()
    return met.mapInPandas(join, "a string, a_names bigint, b string, b_names bigint").distinct()


def near_words(words: DataFrame) -> DataFrame:
    """Pairs of different words within distance 1 (edits 1), of long words within distance 2 (edits 2)."""
    words = cut(words)
    long_words = words.filter(F.length("word") >= LONG_WORD)
    twice = deletion_join(long_words.filter(F.length("word") <= MOST_DELETED))
    twice = twice.unionByName(trie_join(long_words.filter(F.length("word") >= MOST_DELETED - 1), 2))
    return trie_join(words).withColumn("edits", F.lit(1)).unionByName(twice.withColumn("edits", F.lit(2)))


def spellings(pairs: DataFrame) -> DataFrame:
    """word -> right: misspelt words with their attested spelling.

    A long word yields to any better attested one, first to one of distance 1; a short one
    only to one with many times its names, since short words are near each other by
    chance. Words of the fixed lists never yield.
    """
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("b_names").alias("a_names"), F.col("a").alias("b"), F.col("a_names").alias("b_names"), "edits"))
    better = (F.col("b_names") > F.col("a_names")) | ((F.col("b_names") == F.col("a_names")) & (F.col("b") < F.col("a")))
    long_enough = (F.length("a") >= 8) & ((F.col("a_names") <= 2) | (F.col("b_names") >= 3 * F.col("a_names")))
    often = F.when(F.length("a") >= 6, 2).otherwise(4)
    usable = both.filter(better & (long_enough | (F.col("b_names") >= often * F.col("a_names")))).filter(~F.col("a").isin(sorted(SETTLED)))
    best = usable.groupBy("a").agg(F.max_by("b", F.struct(-F.col("edits"), "b_names", F.col("b"))).alias("b"))
    # Spellings that yield in turn are followed to the last one, twice as far each time.
    best = cut(best)
    while True:
        onward = best.select(F.col("a").alias("b"), F.col("b").alias("c"))
        moved = best.join(onward, "b", "left")
        if moved.filter("c IS NOT NULL").isEmpty():
            return best.select(F.col("a").alias("word"), F.col("b").alias("right"))
        best = cut(moved.select("a", F.coalesce("c", "b").alias("b")))


def describe(name: str, right: dict[str, str]) -> dict:
    """What a name says: its key if full, the keys it emits, the keys it looks for (strongest first).

    right gives the attested spelling of misspelt words and what learnt abbreviations stand for.
    """
    toks = [(right.get(t, t), "word" if kind == "cut" and t in right else kind) if kind in ("word", "cut") else (t, kind) for t, kind in tokens(name)]
    org = any(kind in ("word", "cut") and (t in ORG_FULL or ORG_WORDS.get(t) in ORG_FULL and len(t) > 1) for t, kind in toks)
    comma = next((i for i, (_, kind) in enumerate(toks) if kind == "comma"), None)
    legal, words, initials, cuts, acronyms, codes = "", [], [], [], [], []
    for i, (t, kind) in enumerate(toks):
        if kind == "comma" or (kind in ("word", "cut") and (t in ARTICLES or t in TITLES)):
            continue
        if kind == "initial":
            if org and t == "u":
                words.append("university")
            elif not org or t not in "a":
                initials.append((t, i))
        elif t in LEGAL and (org or len(words) > 1):
            legal = LEGAL[t]
        elif kind == "code":
            codes.append(t)
        elif org or kind == "cut":
            full = ORG_WORDS.get(t, t)
            if org and len(t) <= 3 and kind == "word" and t not in ORG_WORDS and any(near_article(t, a) for a in ("of", "for", "and", "the")):
                continue
            (words if org or full != t else cuts).append(full)
        elif kind == "acronym":
            acronyms.append(t)
        else:
            words.append(t)
    out = {"full": None, "emit": [], "seek": [], "mark": "", "short": False}
    plain = [w for w in words if w not in PARTICLES]
    if codes:
        out["full"] = " ".join(sorted(words) + sorted(codes)) if words or codes else None
        return out
    if org:
        if not plain:
            return out
        out["full"], out["mark"] = "org " + " ".join(sorted(plain)), legal
        order = [w for w in plain]
        for w in set(plain):
            rest = "".join(x[0] for x in order if x != w)
            if len(rest) >= 2:
                out["emit"] += [f"A {w} {rest}"] + ([f"A {w} {rest}{legal[0]}"] if legal else [])
        return out
    if len(acronyms) == 1 and len(plain) == 1 and not initials and not cuts:
        out["seek"] = [f"A {plain[0]} {acronyms[0]}"]
        out["full"], out["short"] = f"acronym {plain[0]} {acronyms[0]}", True
        return out
    words += acronyms
    plain = [w for w in words if w not in PARTICLES]
    if not plain:
        return out
    if cuts and len(plain) == 1 and len(cuts) == 1:
        out["seek"] = [f"P {plain[0]} {cuts[0]}"]
        out["full"], out["short"] = f"cut {plain[0]} {cuts[0]}", True
        out["mark"] = initials[0][0] if initials else ""
        return out
    words, plain = words + cuts, plain + cuts
    if len(plain) == 1 and initials:
        first = initials[0][0]
        middle = initials[1][0] if len(initials) > 1 else ""
        out["mark"] = middle
        out["seek"] = ([f"M {plain[0]} {first} {middle}"] if middle else []) + [f"I {plain[0]} {first}"]
        out["full"], out["short"] = f"initial {plain[0]} {first}{middle}", True
        return out
    out["mark"] = initials[0][0] if initials else ""
    out["full"] = " ".join(sorted(plain))
    if len(plain) == 2:
        for given, family in ((plain[0], plain[1]), (plain[1], plain[0])):
            if given in GIVEN_BY_NICK and given not in FAMILIAR:
                formal = GIVEN_BY_NICK[given]
                out["seek"] += [f"N {family} {given}"]
                out["short"] = len(formal) > 1
                if len(formal) == 1:
                    out["full"] = " ".join(sorted([formal[0], family]))
                    given = formal[0]
            out["emit"] += [f"I {family} {given[0]}", f"P {family} {given[:3]}", f"P {family} {given[:4]}", f"P {family} {given[:5]}"]
            if out["mark"]:
                out["emit"] += [f"M {family} {given[0]} {out['mark']}"]
            for nick in FAMILIAR.get(given, "").split():
                out["emit"] += [f"N {family} {nick}"]
        out["seek"] += [f"A {a} {b}" for a, b in (plain, plain[::-1]) if 2 <= len(b) <= 6 and b not in SETTLED]
        if out["short"]:
            out["emit"] = []
    return out


def near_article(token: str, article: str) -> bool:
    return token != article and bool(neighbours(build_trie(iter([(article, 1)])), token, 1))


def described(names: DataFrame, right: DataFrame) -> DataFrame:
    """name, full, mark, short, emit, seek of every name, its words in attested spelling.

    The mark is what tells bearers of one key apart: a middle initial or a legal form.
    """

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(n, w) for n in batch["name"] for w in {t for t, k in tokens(n) if (k == "cut" or k == "word" and len(t) > 1) and t not in SETTLED}]
            yield pd.DataFrame(rows, columns=["name", "word"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, fixes in zip(batch["name"], batch["fixes"]):
                x = describe(name, {f["word"]: f["right"] for f in fixes} if fixes is not None else {})
                if x["full"]:
                    rows.append((name, x["full"], x["mark"], x["short"], x["emit"], x["seek"]))
            yield pd.DataFrame(rows, columns=["name", "full", "mark", "short", "emit", "seek"])

    # Nearly all words of a hot key have no other spelling, so few rows are left after the lookup.
    fixes = (
        lookup_join(names.mapInPandas(explode, "name string, word string"), right, ["word"]).filter("right IS NOT NULL")
        .groupBy("name").agg(F.collect_list(F.struct("word", "right")).alias("fixes"))
    )
    return names.join(fixes, "name", "left").mapInPandas(
        run, "name string, full string, mark string, short boolean, emit array<string>, seek array<string>"
    )


def abbreviation_keys(word: str) -> set[str]:
    """What may stand for a word: its beginnings, also with its last letter or an s, its letters without vowels, its first letter and end."""
    n = len(word)
    bare = word[0] + re.sub("[aeiouy]", "", word[1:])
    keys = {word[:k] for k in range(2, n - 1)} | {bare[:k] for k in range(2, len(bare) + 1)}
    keys |= {k + word[-1] for k in keys} | {k + "s" for k in keys} | {word[0] + word[-k:] for k in range(1, n - 2)}
    return {k for k in keys if 2 <= len(k) < n - 1}


def learnt_abbreviations(names: DataFrame) -> DataFrame:
    """word -> right: short words with the long word they stand for, by the other words of the names that have them.

    Pairs come from equal keys over the vocabulary; only names with a short word that has
    such a pair are compared with others, by equality of all their other words.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name in batch["name"]:
                own = [t for t, kind in tokens(name) if kind in ("word", "cut") and t not in TITLES and t not in ARTICLES and t not in LEGAL]
                if 2 <= len(own):
                    rows += [(t, " ".join(sorted(own[:i] + own[i + 1 :]))) for i, t in enumerate(own)]
            yield pd.DataFrame(rows, columns=["word", "others"])

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(k, w) for w in batch["word"] for k in abbreviation_keys(w)], columns=["word", "long"])

    used = cut(spread(names).mapInPandas(run, "word string, others string").distinct())
    often = used.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_CONTEXTS)
    often = cut(often.filter(~F.col("word").isin(sorted(SETTLED))))
    long_words = often.filter(F.length("word") >= 5).select("word")
    pairs = long_words.mapInPandas(spell, "word string, long string").join(often.select("word"), "word")
    met = used.join(pairs, "word").join(used.select(F.col("word").alias("long"), "others"), ["long", "others"])
    support = met.groupBy("word", "long").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_CONTEXTS)
    best = support.groupBy("word").agg(F.max_by("long", F.struct("n", "long")).alias("right"), F.max("n").alias("most"), F.sum("n").alias("all"))
    return best.filter("3 * most > 2 * all").select("word", "right")


def keyed_entities(described_names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The described names with their entity, and the entities that offer each key: key, least, most."""
    rows = described_names
    # Full names with different middle initials or legal forms are different entities.
    groups = rows.groupBy("full").agg(F.min(F.nullif("mark", F.lit(""))).alias("one"), F.max(F.nullif("mark", F.lit(""))).alias("other"))
    rows = rows.join(groups, "full").withColumn(
        "entity", F.when((F.col("one") != F.col("other")) & ~F.col("short"), F.concat_ws("|", "full", "mark")).otherwise(F.col("full"))
    )
    offers = rows.select("entity", F.explode("emit").alias("key")).groupBy("key").agg(F.min("entity").alias("least"), F.max("entity").alias("most"))
    return rows, offers


def entities(described_names: DataFrame) -> DataFrame:
    """name and entity: names with equal keys, shortened names with the one full name they fit."""
    rows, offers = keyed_entities(described_names)
    wanted = rows.select("name", F.posexplode("seek").alias("rank", "key")).join(offers.filter("least = most").select("key", "least"), "key")
    taken = wanted.groupBy("name").agg(F.min_by("least", "rank").alias("of"))
    return rows.join(taken, "name", "left").select("name", F.coalesce("of", "entity").alias("entity"))


def ambiguous_names(described_names: DataFrame) -> DataFrame:
    """name, and two of the entities it fits: shortened names that join none because they fit several."""
    rows, offers = keyed_entities(described_names)
    wanted = rows.select("name", F.posexplode("seek").alias("rank", "key")).join(offers, "key")
    first = wanted.groupBy("name").agg(
        F.min_by(F.struct("least", "most"), "rank").alias("of"), F.bool_or(F.col("least") == F.col("most")).alias("settled")
    )
    return first.filter("NOT settled").select("name", F.col("of.least").alias("entity_a"), F.col("of.most").alias("entity_b"))


def describe_all(names: DataFrame, column: str = "name") -> DataFrame:
    """described() of the distinct values of a column, with misspellings and abbreviations settled."""
    distinct = cut(spread(names.select(F.col(column).alias("name")).filter(F.trim("name") != "").distinct()))
    right = spellings(cut(near_words(words_of(spread(distinct)))))
    learnt = learnt_abbreviations(distinct)
    right = cut(learnt.unionByName(right.join(learnt.select("word"), "word", "left_anti")))
    return cut(described(spread(distinct), right))


def variant_pairs(names: DataFrame, column: str = "name") -> DataFrame:
    """name_a < name_b for every two spellings of an entity among the distinct values of a column."""
    found = cut(entities(describe_all(names, column)))
    many = found.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("entity")
    found = found.join(many, "entity")
    a, b = found.select("entity", F.col("name").alias("name_a")), found.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").filter("name_a < name_b").select("name_a", "name_b")


def all_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, relations = table(spark, sf_dir, "knowledge_graph_node"), table(spark, sf_dir, "ekr_vdb_relation")
    return (
        nodes.select(F.col("id").alias("name"))
        .unionByName(relations.select(F.explode(F.array("source_id", "target_id")).alias("name")))
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p1_found: all pairs of spellings of one person or organisation."""
    return variant_pairs(all_names(spark, sf_dir))


def p1_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p1_ambiguous: shortened names that fit several entities, with two of them."""
    return ambiguous_names(describe_all(all_names(spark, sf_dir)))


def p1_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p1_entities: every name with its entity and the number of the entity's spellings: the links without a row for each pair."""
    found = cut(entities(describe_all(all_names(spark, sf_dir))))
    sizes = found.groupBy("entity").agg(F.count(F.lit(1)).alias("n_spellings"))
    return found.join(sizes, "entity").select("name", "entity", "n_spellings")


QUERIES = {"p1_found": p1_found, "p1_entities": p1_entities, "p1_ambiguous": p1_ambiguous}
ORACLES: dict[str, str] = {}
