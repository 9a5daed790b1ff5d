"""Scanned documents, and their running lines and page numbers, found by classifiers.

Whether a document was scanned is told from the lengths and ends of all its lines.

The classifiers read features of a line, of its neighbours and of the lines of the
document that look like it. They are trained on pages that are made from paragraphs of the
corpus: wrapped, cut into pages, with running lines, page numbers, tables, captions and
misread characters put in; clean texts are made of the same paragraphs, a line each.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np

from lodestack.llm.boosting import Boosted

# Characters that scanners take for others.
MISREAD = {
    "e": ["c"], "c": ["e", "¢"], "h": ["b"], "b": ["6", "h"], "i": ["1", "l", "!"], "l": ["1", "I"], "o": ["0"], "s": ["5", "ſ"],
    "t": ["†"], "f": ["ſ", "t"], "a": ["@", "o"], "m": ["rn"], "n": ["ri", "u"], "u": ["ii", "n"], "d": ["cl"], "g": ["9", "q"],
    "w": ["vv"], "v": ["y"], "B": ["8"], "S": ["5"], "O": ["0"], "I": ["1", "l"], "l1": ["1"], "z": ["2"], "rn": ["m"], "cl": ["d"],
}
SYMBOLS = str.maketrans("0156@†¢ſ|!89", "olsbatcfllbg")
HYPHENS = "-‐¬­"
ROMAN = re.compile(r"^[ivxlcIVXLC]{1,8}$")
NUMBER = r"[0-9OoIlSBZ|]{1,5}"
PAGE = re.compile(
    rf"^[\s\-–—\[(|~*.]*(?P<word>(?:p|page|pag|pág|página|seite|s|pg|blatt|folio)\b\.?)?\s*(?P<n>{NUMBER})(?:\s*(?:/|of|de|von|sur)\s*(?P<m>{NUMBER}))?[\s\-–—\])|~*.]*$",
    re.I,
)
_START_NUMBER = re.compile(rf"^({NUMBER})\b")
_END_NUMBER = re.compile(rf"({NUMBER})$")
_EDGE_NUMBER = re.compile(rf"^{NUMBER}\b(?=\s{{2,}}|\s*[|·–-])|(?:\s{{2,}}|[|·–-]\s*){NUMBER}$")
_DIGITS = str.maketrans("OoIlSBZ|", "00115821")
_DIGIT, _DIGIT_IN_WORD = re.compile(r"\d"), re.compile(r"[^\W\d_]\d|\d[^\W\d_]")
_NUMBERS, _NO_LETTERS = re.compile(r"\d+(?:\s*[/|]\s*\d+)?"), re.compile(r"[\W\d_]+")
_LOOK_ALIKE = str.maketrans("ehviu", "cbyln")
FEATURES = 27


def number_of(text: str) -> int | None:
    """The number that a text of digits and digit-like letters stands for; needs a digit."""
    if not any(c.isdigit() for c in text):
        return None
    plain = text.translate(_DIGITS)
    return int(plain) if plain.isdigit() else None


def roman_of(text: str) -> int | None:
    if not ROMAN.match(text):
        return None
    values, total = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}, 0
    digits = [values[c] for c in text.lower()]
    for a, b in zip(digits, digits[1:] + [0]):
        total += -a if a < b else a
    return total


def page_of(line: str) -> tuple[int, int] | None:
    """(number, how it is written) if the line has nothing but what could be a page number."""
    m = PAGE.match(line)
    if m:
        n = number_of(m["n"])
        if n is not None:
            bare = line.strip()
            style = 1 if m["word"] else 2 if m["m"] else 3 if bare[:1] in "-–—[(~" else 4
            return n, style
    n = roman_of(line.strip(" -–—[]()."))
    return (n, 5) if n is not None else None


def skeleton(line: str) -> str:
    """What stays of a line under misreading: letters only, look-alikes made equal."""
    s = line.lower()
    if _DIGIT.search(s) and not _DIGIT_IN_WORD.search(line):
        s = _NUMBERS.sub(" ", s)
    s = _NO_LETTERS.sub("", s.translate(SYMBOLS))
    s = s.replace("rn", "m").replace("ri", "n").replace("ii", "u").replace("cl", "d")
    return s.translate(_LOOK_ALIKE)


def figures(line: str) -> bool:
    if sum(map(str.isalpha, line)) > 4:
        return False
    return bool(re.fullmatch(r"[\d.,%+\-–OlI]+(?:\s+[\d.,%+\-–OlI]+)*", line.strip())) and any(c.isdigit() for c in line)


def chained(values: list[int]) -> list[bool]:
    """Which numbers in order of appearance go on by one from another of them."""
    places = defaultdict(list)
    for i, v in enumerate(values):
        places[v].append(i)
    return [any(j < i for j in places.get(v - 1, ())) or any(j > i for j in places.get(v + 1, ())) for i, v in enumerate(values)]


def line_features(lines: list[str]) -> tuple[list[int], np.ndarray]:
    """Places of the lines that aren't blank, and their features."""
    bare = [line.replace("\x0c", "").strip() for line in lines]
    at = [i for i, s in enumerate(bare) if s]
    n = len(at)
    x = np.zeros((n, FEATURES))
    if not n:
        return at, x
    text = [bare[i] for i in at]
    lengths = np.array([len(s) for s in text])
    usual = float(np.median(lengths))
    pages = [page_of(s) for s in text]
    style_count = Counter(p[1] for p in pages if p)
    rows = [figures(s) for s in text]
    by_style: dict[int, list[int]] = defaultdict(list)
    for i, p in enumerate(pages):
        if p:
            by_style[p[1]].append(i)
    chain = np.zeros(n, bool)
    for own in by_style.values():
        for i, ok in zip(own, chained([pages[i][0] for i in own])):
            chain[i] = ok
    feed = np.array(["\x0c" in lines[i] or (i + 1 < len(lines) and "\x0c" in lines[i + 1]) for i in at])
    mark = np.array([bool(p) and (p[1] in (1, 2, 3) or bool(c)) for p, c in zip(pages, chain)])
    skeletons = [skeleton(s) if not r else "" for s, r in zip(text, rows)]
    groups: dict[str, list[int]] = defaultdict(list)
    for i, k in enumerate(skeletons):
        if len(k) >= 4:
            groups[k].append(i)
    _merge_like(groups)
    member: dict[int, list[int]] = {i: own for own in groups.values() for i in own}
    ends = [s[-1] in ".!?:…" for s in text]
    starts_low = [s[0].islower() for s in text]
    body = lengths > 0.55 * usual

    def text_before(i: int) -> int | None:
        j = i - 1
        while j >= 0 and i - j <= 3 and (mark[j] or (skeletons[j] and len(member.get(j, ())) > 1 and not body[j])):
            j -= 1
        return j if j >= 0 else None

    def text_after(i: int) -> int | None:
        j = i + 1
        while j < n and j - i <= 3 and (mark[j] or (skeletons[j] and len(member.get(j, ())) > 1 and not body[j])):
            j += 1
        return j if j < n else None

    cut = [0.0] * n
    for i in range(n):
        b, a = text_before(i), text_after(i)
        open_ = b is not None and not ends[b] and not rows[b]
        low = a is not None and (starts_low[a] or (b is not None and text[b][-1] in HYPHENS))
        cut[i] = (open_ and low) + 0.4 * (open_ != low)
    m = np.pad(mark, 1)
    f = np.pad(feed, 1)
    near = (m[:-2] | m[2:] | f[:-2] | f[1:-1] | f[2:]).tolist()
    # What the lines of a group share is made once a group.
    shared: dict[int, tuple] = {}

    def group_of(i: int) -> tuple:
        own = member.get(i)
        if own is None or len(own) == 1:
            return 1, cut[i], near[i], 0.0, 2.0, None
        first = own[0]
        if first not in shared:
            gaps = [at[b] - at[a] for a, b in zip(own, own[1:])]
            mean = sum(gaps) / len(gaps)
            spread = (sum((g - mean) ** 2 for g in gaps) / len(gaps)) ** 0.5 / max(1.0, mean)
            numbers = []
            for j in own:
                m = _START_NUMBER.match(text[j]) or _END_NUMBER.search(text[j])
                v = number_of(m[1]) if m else None
                numbers.append(v if v is not None else -9)
            chains = chained(numbers)
            shared[first] = (
                len(own), sum(cut[j] for j in own) / len(own), sum(near[j] for j in own) / len(own), min(gaps), spread, sum(chains) / len(own),
            )
        return shared[first]

    marks = int(mark.sum())
    for i, s in enumerate(text):
        many, cuts, nears, gap, spread, chains = group_of(i)
        p = pages[i]
        letters = _NO_LETTERS.sub("", s)
        numbered = bool(_EDGE_NUMBER.search(s)) if _DIGIT.search(s) else False
        words = s.split()
        x[i] = (
            many, cuts, cut[i], near[i], nears,
            len(s) / usual, s[-1] == ".", s[-1] == ":", s[0] in "([" and s[-1] in ")]", numbered,
            chains if numbered and chains is not None else 0, p[1] if p else 0, chain[i], bool(p) and p[1] == 4,
            (i > 0 and rows[i - 1]) + (i + 1 < n and rows[i + 1]), len(letters) / len(s),
            sum(map(str.isupper, letters)) / max(1, len(letters)), sum(w[0].isupper() for w in words) / len(words),
            at[i] > 0 and not bare[at[i] - 1], at[i] + 1 < len(bare) and not bare[at[i] + 1], min(i, n - 1 - i, 3),
            gap, spread, marks, rows[i], style_count[p[1]] if p else 0, len(words),
        )
    return at, x


def _occurrences(key: str) -> list[tuple[str, int]]:
    """The pairs of letters of a key, each with how often it has occurred before."""
    pairs = [key[i : i + 2] for i in range(len(key) - 1)]
    if len(set(pairs)) == len(pairs):
        return [(g, 0) for g in pairs]
    seen: dict[str, int] = {}
    out = []
    for g in pairs:
        n = seen.get(g, 0)
        out.append((g, n))
        seen[g] = n + 1
    return out


def _merge_like(groups: dict[str, list[int]]) -> None:
    """Join groups of lines whose skeletons differ in few letters.

    A key meets the heads that have one of its rarest pairs of letters, of which it takes so
    many that no head with enough pairs in common is missed; the first such head gets it.
    """
    keys = sorted((k for k in groups if len(k) >= 6), key=lambda k: -len(groups[k]))
    heads = [k for k in keys if len(groups[k]) > 1]
    if not heads:
        return
    own = [set(_occurrences(h)) for h in heads]
    index: dict[tuple[str, int], list[int]] = defaultdict(list)
    for n, grams in enumerate(own):
        for g in grams:
            index[g].append(n)
    sizes = np.zeros(max(map(len, keys)) + 5, bool)
    for h in heads:
        sizes[max(0, len(h) - 3) : len(h) + 4] = True
    for k in keys:
        if not sizes[len(k)]:
            continue
        grams = _occurrences(k)
        need = max(1, int(np.ceil(0.72 * len(k) - 1)))
        rarest = sorted(grams, key=lambda g: len(index.get(g, ())))[: len(grams) - need + 1]
        near = {n for g in rarest for n in index.get(g, ()) if -4 < len(heads[n]) - len(k) < 4}
        for n in sorted(near):
            head = heads[n]
            if head == k or head not in groups or len(groups[head]) < len(groups[k]):
                continue
            if len(own[n].intersection(grams)) >= 0.72 * max(len(k), len(head)) - 1:
                groups[head] = sorted(groups[head] + groups.pop(k))
                break


def misread(text: str, rng: np.random.Generator, share: float) -> str:
    """The text with a share of its letters misread."""
    out = []
    for c in text:
        options = MISREAD.get(c)
        out.append(options[rng.integers(len(options))] if options and rng.random() < share else c)
    return "".join(out)


def roman(n: int) -> str:
    out = ""
    for value, sign in ((100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        while n >= value:
            out, n = out + sign, n - value
    return out


def made_document(rng: np.random.Generator, paragraphs: list[str]) -> tuple[list[str], list[int]]:
    """Lines of made pages and their labels: 0 text, 1 header, 2 page number."""
    width, per_page = int(rng.integers(45, 78)), int(rng.integers(14, 44))
    words = " ".join(paragraphs[int(i)] for i in rng.integers(0, len(paragraphs), 4)).split()

    def phrase(lo: int, hi: int) -> str:
        return " ".join(re.sub(r"\W", "", words[int(i)]) for i in rng.integers(0, len(words), int(rng.integers(lo, hi))))

    def cased(s: str) -> str:
        return (s.upper(), s.title(), s.title())[int(rng.integers(3))]

    traps = [f"{phrase(1, 3).capitalize()}:", phrase(1, 3).upper(), f"({phrase(2, 4).lower()})", phrase(2, 5).capitalize()]
    traps = [t for t in traps if rng.random() < 0.5]
    lines: list[str] = []
    title = phrase(3, 6).title()
    if rng.random() < 0.6:
        lines += [cased(title), ""]
    indent, spaced = rng.random() < 0.4, rng.random() < 0.5
    for _ in range(int(rng.integers(3, 16))):
        r = rng.random()
        if traps and r < 0.22:
            lines.append(traps[int(rng.integers(len(traps)))])
        elif r < 0.34:
            whole = rng.random() < 0.5
            for _ in range(int(rng.integers(2, 6))):
                many = int(rng.integers(1, 5))
                lines.append("   ".join(str(int(rng.integers(1, 500))) if whole else f"{rng.random() * 99:.1f}" for _ in range(many)))
        elif r < 0.42:
            lines.append(f"{rng.integers(1, 9)}.{rng.integers(1, 9)} {phrase(2, 4).title()}")
        line = "   " if indent else ""
        for w in paragraphs[int(rng.integers(len(paragraphs)))].split():
            if len(line) + len(w) > width:
                room = width - len(line) - 1
                if len(w) > 6 and 2 < room < len(w) - 2 and rng.random() < 0.7:
                    lines.append(line + w[:room] + "-")
                    line = w[room:] + " "
                    continue
                lines.append(line.rstrip())
                line = ""
            line += w + " "
        lines.append(line.rstrip())
        if spaced:
            lines.append("")
    running, numbering = int(rng.integers(6)), int(rng.integers(8))
    start, total = int(rng.integers(1, 400)), int(rng.integers(5, 30))
    head_a, head_b, issue = cased(title), (cased(phrase(2, 5)), phrase(2, 4).title(), f"{phrase(1, 3).capitalize()} {rng.integers(1000, 99999)}")[int(rng.integers(3))], f"{phrase(1, 3).title()} {rng.integers(1, 99)}/{rng.integers(1, 999)}"
    top_head, top_number, feeds = rng.random() < 0.5, rng.random() < 0.4, rng.random() < 0.2
    noise = (0.0, 0.01, 0.05)[int(rng.integers(3))]
    out, labels = [], []

    def put(s: str, label: int) -> None:
        out.append(s)
        labels.append(label)

    for page, lo in enumerate(range(0, len(lines), per_page)):
        n = start + page
        number = {0: None, 1: str(n), 2: f"- {n} -", 3: f"Page {n}", 4: f"p. {n}/{start + total}", 5: f"[ {n} ]", 6: roman(n % 89 + 1), 7: None}[numbering]
        head = {0: None, 1: head_a, 2: head_a if page % 2 else head_b, 3: f"{head_a} | {n}" if page % 2 else f"{n}    {head_a}", 4: issue, 5: f"{head_a} | {n}"}[running]
        if running in (3, 5):
            number = None
        if head and rng.random() < 0.12 and running != 3:
            head = None
        edges = [(misread(number, rng, noise), 2, top_number)] if number else []
        edges += [(misread(head, rng, noise), 1, top_head)] if head else []
        if rng.random() < 0.5:
            edges.reverse()
        first = True
        for s, label, top in edges:
            if top:
                put(("\x0c" if feeds and page and first else "") + s, label)
                first = False
        if rng.random() < 0.15:
            put("", 0)
        for line in lines[lo : lo + per_page]:
            put(misread(line, rng, noise / 3), 0)
        if rng.random() < 0.15:
            put("", 0)
        for s, label, top in edges:
            if not top:
                put(s, label)
    return out, labels


SHAPE = 15


def shape(lines: list[str]) -> np.ndarray:
    """What tells a scan from a clean text: how long its lines are and how they end."""
    text = [s for s in (line.replace("\x0c", "").strip() for line in lines) if s]
    x = np.zeros(SHAPE)
    if not text:
        return x
    n = np.array([len(s) for s in text])
    q50, q75, q90 = np.quantile(n, (0.5, 0.75, 0.9))
    open_ = np.array([s[-1] not in ".!?:…\"”»)" for s in text])
    low = np.array([s[0].islower() for s in text])
    goes_on = open_[:-1] & low[1:]
    body = n > 0.5 * q90
    x[:] = (
        np.log1p(len(n)), q50, q75, q90, n.max(), n[n > 110].sum() / n.sum(), n[n <= 110].sum(), open_.mean(), goes_on.sum() / max(1, len(n) - 1), goes_on.sum(),
        sum(s[-1] in HYPHENS for s in text) / len(n), n[body].std() / n[body].mean(), (n[n > 0.8 * q90] <= 1.15 * q90).mean(),
        any("\x0c" in line for line in lines), sum(s.count(c) for s in text for c in "†¢ſ") / n.sum(),
    )
    return x


def made_clean(rng: np.random.Generator, paragraphs: list[str]) -> list[str]:
    """Lines of a made clean text: paragraphs of one line each, among headings, short notes, lists and blank lines."""
    out: list[str] = []
    for i in rng.integers(0, len(paragraphs), int(rng.integers(1, 14))):
        words = paragraphs[int(i)].split()
        r = rng.random()
        if r < 0.15:
            out.append(("", "# ", "## ", f"## {rng.integers(1, 9)}. ")[int(rng.integers(4))] + " ".join(words[: int(rng.integers(2, 7))]).title())
        elif r < 0.3:
            out += [f"- {' '.join(words[j : j + int(rng.integers(2, 9))])}" for j in range(0, min(len(words), 40), 9)]
        elif r < 0.45:
            out.append(re.split(r"(?<=[.!?])\s", paragraphs[int(i)])[0])
        else:
            out.append(paragraphs[int(i)])
        if rng.random() < 0.3:
            out.append("")
    return out


def damaged(rng: np.random.Generator, lines: list[str]) -> list[str]:
    """A made scan of which sometimes only few lines are left, or lines have run together."""
    out = list(lines)
    if rng.random() < 0.25:
        lo = int(rng.integers(0, max(1, len(out) - 6)))
        out = out[lo : lo + int(rng.integers(2, 7))]
    if rng.random() < 0.4:
        for _ in range(int(rng.integers(1, 4))):
            if len(out) > 3:
                at = int(rng.integers(0, len(out) - 1))
                out[at : at + 2] = [f"{out[at]} {out[at + 1]}"]
    return out


class Furniture:
    """Classifiers for scans, headers and page numbers, trained on made documents."""

    def __init__(self, paragraphs: list[str], documents: int = 400, seed: int = 5):
        rng = np.random.default_rng(seed)
        xs, ys, shapes, scans = [], [], [], []
        for _ in range(documents):
            lines, labels = made_document(rng, paragraphs)
            at, x = line_features(lines)
            xs.append(x)
            ys.append(np.array(labels)[at])
            for made, is_scan in ((damaged(rng, lines), True), (damaged(rng, lines), True), (made_clean(rng, paragraphs), False), (made_clean(rng, paragraphs), False)):
                shapes.append(shape(made))
                scans.append(is_scan)
        x, y = np.concatenate(xs), np.concatenate(ys)
        self.header = Boosted(50, 4).fit(x, y == 1)
        self.number = Boosted(50, 4).fit(x, y == 2)
        self.scan = Boosted(50, 4).fit(np.array(shapes), np.array(scans))

    def kinds(self, lines: list[str]) -> list[str]:
        """header, page_number, text or blank for every line of a scan."""
        return self.all_kinds([lines])[0]

    def all_kinds(self, documents: list[list[str]]) -> list[list[str]]:
        """kinds() of several scans at once."""
        read = [line_features(lines) for lines in documents]
        x = np.concatenate([x for _, x in read]) if read else np.zeros((0, FEATURES))
        heads, numbers = self.header.predict(x), self.number.predict(x)
        out, lo = [], 0
        for lines, (at, own) in zip(documents, read):
            kinds = ["blank"] * len(lines)
            for i, head, number in zip(at, heads[lo : lo + len(own)], numbers[lo : lo + len(own)]):
                kinds[i] = "page_number" if number > 0.5 and number >= head else "header" if head > 0.5 else "text"
            out.append(kinds)
            lo += len(own)
        return out

    def read(self, contents: list[str]) -> list[list[str] | None]:
        """The kinds of the lines of every content, None for clean texts."""
        split = [c.split("\n") for c in contents]
        scanned = self.scan.predict(np.array([shape(lines) for lines in split])) > 0.5 if split else []
        kinds = iter(self.all_kinds([lines for lines, yes in zip(split, scanned) if yes]))
        return [next(kinds) if yes else None for yes in scanned]


def paragraphs_of(contents: list[str], most: int = 3000) -> list[str]:
    """At most `most` paragraphs to make documents of: long lines, or joined lines of contents where there are few."""
    long_lines = [p.strip() for c in contents for p in (c or "").split("\n") if len(p) > 120]
    if len(long_lines) < 20:
        long_lines += [" ".join((c or "").split()) for c in contents if c and len(c) > 120]
    return long_lines[:most]
