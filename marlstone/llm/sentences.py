"""Sentence boundaries across languages and scripts.

A text is cut into blocks first: fenced code, headings, list entries, and prose, whose line
markers (quotes, comments) are blanked but keep their places. In prose:

* **Spaced scripts** get a lattice of terminators. Every end mark before white space is a node; an
  edge between two nodes is a possible sentence. An edge pays for every end mark it runs
  over (much for a clear one, nothing for an abbreviation), for ending at a doubtful mark,
  and for cutting a quotation or bracket in two. The cheapest path is the segmentation.
  Clear marks beyond which no quotation is open cut the lattice, and an edge that has run over
  too much is given up, so time grows with the text and not with the square of a paragraph.
* **Spaceless scripts** get a word lattice over the whole clause on either side of a gap: the
  cheapest way through a dictionary, which holds the words of a public vocabulary, weighted by rank, and
  particles, endings and connectives. A gap is classified by the final particle before it and the
  opening word after it: an ellipsis before a connective goes on, and so does a closed quotation
  before a quotative. In a paragraph without any end mark every word boundary is a gap, and those between
  a final particle and an opening word end a sentence.
* **Thai** ends at white space between two Thai characters.
"""

from __future__ import annotations

import base64
import math
import re
from collections import deque
from collections.abc import Iterator
from functools import cache
from pathlib import Path
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.session import ship

# Abbreviations after which a sentence goes on.
GOES_ON = frozenset("""
e.g i.e vs approx ca cf fig figs no nos sec incl excl resp eq ref refs vol ch pp al ed eds est dept inc ltd co mr mrs ms dr prof st jr sr
max min avg viz op cit seq
z.b d.h u.a bzw nr vgl abschn abb tab bd kap zzgl ggf inkl evtl ca sog s.o s.u o.ä z.t u.u bspw mind höchst hr fr
p.ej p.ex p ej ex aprox núm num pág págs art arts cap c.-à-d env v n° réf ee sr sra dra
т.е т.к и.т т см рис гл ок стр напр табл п пп ст г гг тыс млн млрд руб ред ср н.э им
सं डॉ श्री पृ
""".split())
# Abbreviations that also stand at the end of a sentence.
MAY_END = frozenset("etc usw и.т.д и.т.п u.s.w u.s uu ee.uu и.др a.m p.m jr inc ltd co".split())
# Words that are capitalised in German only where a sentence begins.
GERMAN_OPENERS = frozenset("""
die der das dem den des ein eine einer einem einen eines kein keine dieser diese dieses jeder jede jedes er sie es wir ihr ich man wer was
wie wo wann warum wenn weil obwohl während als nach bei mit in auf an zu von für aber und oder doch dann hier dort so nun auch nur noch
sein seine ihre unser unsere mein meine sobald falls nachdem bevor damit dort
""".split())
# Particles, endings and connectives of the spaceless scripts, by what they say of a gap.
FINAL = "了 吧 呢 吗 啊 呀 嘛 的 です ます ました でした だ だった た る ない よ ね か な わ ぞ さ".split()
CONNECTIVES = "然后 而且 而 但是 但 可是 却 于是 所以 并且 并 也 因此 不过 そして しかし だが でも だから それで それから また が けれど けれども つまり".split()
QUOTATIVES = "と って という といって とは との などと 他们 她们 他 她 我 我们 大家 有人 这样说 说 道 问 写道".split()
OTHERS = "は が を に で の へ も や から まで より ので のに なら 前に あとで ときは 是 在 和 与 把 被 对 从 到 如果 因为 虽然 即使 只要 除非 一旦 当".split()
PRONOUNS = tuple("我 你 您 他 她 它 咱 私 僕 彼".split())
# Polite and past endings after which a sentence without marks may end.
ENDINGS = tuple("です ます ました でした ません だった 了 吧 呢 吗 啊 呀 嘛".split())
_KINDS = {w: kind for kind, ws in (("other", OTHERS), ("final", FINAL), ("connective", CONNECTIVES), ("quotative", QUOTATIVES)) for w in ws}

#: A public vocabulary (token in base 64 and rank on each line) whose words are the dictionary of the spaceless scripts.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Cost of a sign that no entry of the dictionary covers.
UNKNOWN = 12.0
#: Quotations and brackets that can be open at once; the outermost of more is forgotten.
NESTED = 32
#: Line markers within line markers; what is deeper is prose.
LEVELS = 20

OPEN, CLOSE = "([{（［【「『〈《“„«‹‘\"", ")]}）］】」』〉》”“»›’\""
PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "【": "】", "「": "」", "『": "』", "〈": "〉", "《": "》", "«": "»", "‹": "›"}
_CLOSERS = r"[\"”“»›’'）)\]}］】」』〉》*_]*+"
EAST = "぀-ヿ㐀-鿿豈-﫿ｦ-ﾟ"
EAST_RUN = re.compile(f"[{EAST}]+")
SPACE = re.compile(r"\s*")
WORD = re.compile(r"\w+")
CANDIDATE = re.compile(
    rf"(?P<east>(?:[。｡！？]|(?<=[{EAST}])[!?])[。｡！？!?…]*+{_CLOSERS})|(?P<dots>(?<=[{EAST}）」』])(?:…+|⋯+|\.\.\.+))"
    rf"|(?P<end>(?<![.!?…।॥؟۔])[.!?…।॥؟۔]++{_CLOSERS})(?=\s|$)"
    r"|(?P<thai>(?<=[฀-๿])\s+(?=[฀-๿]))")
QUOTES = re.compile(r"[()\[\]{}（）［］【】「」『』〈〉《》«»‹›“”„\"]")
FENCE = re.compile(r"[ \t]*(`{3,}|~{3,})")
HEADING = re.compile(r"[ \t]{0,3}(#{1,6}|={1,6})[ \t]+(?=\S)")
LIST = re.compile(r"[ \t]*(?:[-*+•‣◦]|(\d{1,9})[.)])[ \t]+(?=\S)")
PREFIX = re.compile(r"[ \t]*(?:(>)[ \t]?(?:>[ \t]?)*|(//)/*!?|(--)(?=[ \t])|(\|)(?=[ \t])|(;)+(?=[ \t])|(%)+(?=[ \t])|(#)(?=[ \t])|(?<=[ \t])(\*)(?=[ \t]|$)|(/\*)\**|(?<=[ \t])(\*/))[ \t]?")
RULE = re.compile(r"[ \t]*(?:[-=*_~+|:][ \t]*){3,}$|[ \t]*[#>*|/]+[ \t]*$")
WORD_START = re.compile(r"[\"“”„«‹‘'(\[{*_¿¡]*")
IDENTIFIER = re.compile(r"\w+(?:_\w+)+|\w+\(\)|\w+(?:\.\w+)+\(")
INTEGER = re.compile(r"\d+(?![\d.,%])(?=\s)")

#: Costs of the terminator lattice.
SKIP_CLEAR, END_DOUBT, CUT_PAIR, NEVER = 10.0, 3.0, 8.0, 1e9
#: An edge that has run over so much is given up; cutting at a clear mark costs less.
GIVE_UP = 60.0


class Dictionary:
    """Words of the spaceless scripts with their costs, by first sign."""

    def __init__(self, vocabulary: bytes = b"") -> None:
        cost = {}
        for line in vocabulary.splitlines():
            token, _, rank = line.partition(b" ")
            try:
                word = base64.b64decode(token).decode().strip()
            except ValueError:  # a part of a sign
                continue
            if EAST_RUN.fullmatch(word):
                cost.setdefault(word, math.log(2 + int(rank)))
        for word in (*_KINDS, *PRONOUNS, *ENDINGS):
            cost[word] = min(cost.get(word, 99.0), 5.0 + 0.5 * len(word))
        self.single = {w: c for w, c in cost.items() if len(w) == 1}
        self.longer: dict[str, list[tuple[str, int, float]]] = {}
        for w, c in cost.items():
            if len(w) > 1:
                self.longer.setdefault(w[0], []).append((w, len(w), c))
        self.size = len(cost)

    def words(self, s: str) -> list[str]:
        """The cheapest way through the lattice of all words that occur in ``s``."""
        n = len(s)
        best, back = [0.0] + [1e18] * n, [0] * (n + 1)
        single, longer = self.single, self.longer
        for i, ch in enumerate(s):
            here = best[i]
            c = here + single.get(ch, UNKNOWN)
            if c < best[i + 1]:
                best[i + 1], back[i + 1] = c, i
            for w, size, cost in longer.get(ch, ()):
                if s.startswith(w, i) and here + cost < best[i + size]:
                    best[i + size], back[i + size] = here + cost, i
        out = []
        while n:
            out.append(s[back[n]:n])
            n = back[n]
        return out[::-1]


@cache
def dictionary(path: str = VOCABULARY) -> Dictionary:
    return Dictionary(Path(path).read_bytes())


def _east_end(s: str, m: re.Match, inside: tuple, start: int, known: Dictionary) -> bool:
    """Does a sentence end at this mark of a spaceless script?"""
    mark_end = m.end()
    at = SPACE.match(s, mark_end).end()
    if at == len(s):
        return True
    first = s[at]
    if m["dots"]:
        if first in "，、,;；":
            return False
        before = known.words(s[max(start, _clause(s, m.start())):m.start()])
        if not before or not before[-1].endswith(tuple(FINAL)):
            return False
        run = EAST_RUN.match(s, at)
        kind = _KINDS.get(known.words(run[0])[0]) if run else None
        return kind != "connective" and (mark_end == len(s) or kind != "other")
    if first in "，、,;；:：–—）)」』":
        return False
    if inside:
        if any(c >= mark_end for _, c in inside):
            return False
        # the mark closes a quotation: a quotative takes it up again
        run = EAST_RUN.match(s, at)
        return not run or _KINDS.get(known.words(run[0])[0]) != "quotative"
    return True


def _clause(s: str, end: int) -> int:
    """Where the run of spaceless script before ``end`` begins."""
    i = end
    while i and EAST_RUN.match(s, i - 1, i):
        i -= 1
    return i


def _markless(s: str, known: Dictionary) -> list[int]:
    """Ends of sentences in a paragraph of spaceless script that has no end mark: after a final particle, before an opening word."""
    out = []
    for run in EAST_RUN.finditer(s):
        words = known.words(run[0])
        at = run.start()
        for here, after in zip(words, words[1:]):
            at += len(here)
            if here.endswith(ENDINGS) and (after.startswith(PRONOUNS) or _KINDS.get(after) == "connective" and after not in ("が", "けれど", "けれども", "でも", "也", "却")):
                out.append(at)
    return out


def quote_pairs(s: str) -> list[tuple[int, int]]:
    """(open, close) of the quotations and brackets, by first sign; two of them are apart or one holds the other."""
    out, stack = [], deque(maxlen=NESTED)
    for m in QUOTES.finditer(s):
        ch, i = m[0], m.start()
        if ch in "“\"”":
            before, after = s[i - 1:i], s[i + 1:i + 2]
            top = next((x for x in reversed(stack) if x[0] in "“\"„”"), None)
            opens = ch != "”" and (not before or before.isspace() or before in OPEN) and bool(after) and not after.isspace()
            if ch == "“" and top and top[0] == "„":
                opens = False
            if opens:
                stack.append((ch, i))
            elif top:
                while stack[-1] is not top:
                    stack.pop()
                out.append((stack.pop()[1], i))
        elif ch in PAIRS or ch == "„":
            stack.append((ch, i))
        else:
            top = next((x for x in reversed(stack) if PAIRS.get(x[0]) == ch), None)
            if top:
                while stack[-1] is not top:
                    stack.pop()
                out.append((stack.pop()[1], i))
    out.sort()
    return out


def _open_at(marks: list[re.Match], pairs: list[tuple[int, int]]) -> list[tuple[tuple[int, int], ...]]:
    """The pairs that each mark lies in, outermost first."""
    out, held, k = [], [], 0
    for m in marks:
        at = m.start()
        while k < len(pairs) and pairs[k][0] < at:
            while held and held[-1][1] < pairs[k][0]:
                held.pop()
            held.append(pairs[k])
            k += 1
        while held and held[-1][1] <= at:
            held.pop()
        out.append(tuple(held))
    return out


def _abbreviation(s: str, at: int, lo: int) -> str:
    """The word before the full stop at ``at`` with the stops in it, and what was left of a spaced one ("и т. д.")."""
    i = at
    while i > lo and not s[i - 1].isspace():
        i -= 1
    word = s[i:at].lstrip("\"“”„«‹‘'([{*_—–").lower()
    if len(word) <= 2 and word.isalpha():
        j = i
        parts = [word]
        for _ in range(2):
            k = j
            while k > lo and s[k - 1].isspace():
                k -= 1
            b = k
            while b > lo and not s[b - 1].isspace():
                b -= 1
            before = s[b:k].lstrip("\"“”„«‹‘'([{*_").lower()
            if before.endswith(".") and len(before) <= 4 or before == "и":
                parts.insert(0, before.rstrip("."))
                j = b
            else:
                break
        for k in range(len(parts) - 1):
            if (whole := ".".join(parts[k:])) in MAY_END or whole in GOES_ON:
                return whole
    return word


def _opens(s: str, i: int) -> str:
    """What begins at ``i``: "upper", "lower", "mark" (dash, comma and the like), "name", "number" or ""."""
    while i < len(s) and s[i].isspace():
        i += 1
    if i == len(s):
        return ""
    j = WORD_START.match(s, i).end()
    if j == len(s):
        return "mark"
    if IDENTIFIER.match(s, j):
        return "name"
    ch = s[j]
    if ch.isdigit():
        return "number" if INTEGER.match(s, j) else "lower"
    if ch.isalpha():
        if ch.islower():
            return "lower"
        k = j
        while k < len(s) and (s[k].isalnum() or s[k] in "'’"):
            k += 1
        if s[k:k + 1] == "." and s[j:k].lower() in GOES_ON:
            return "lower"
        return "upper"
    return "mark"


def _judge(s: str, m: re.Match, lo: int, german: bool) -> tuple[float, float]:
    """(cost of ending here, cost of going on) from the mark and its neighbours alone."""
    mark = m["end"]
    stops = mark.rstrip("\"”“»›’'）)]}］】」』〉》*_")
    closers = mark[len(stops):]
    at = m.start()
    opens = _opens(s, m.end())
    if opens == "":
        return 0.0, SKIP_CLEAR
    alone = at == lo or s[at - 1].isspace() or s[at - 1] in OPEN
    if stops[0] == "…" or stops.startswith(".."):
        if alone:
            return NEVER, 0.0
        if opens in ("upper", "name", "number"):
            return 0.0, SKIP_CLEAR
        return (NEVER, 0.0) if closers or stops[0] == "…" or opens in ("lower", "mark") else (0.0, SKIP_CLEAR)
    if closers and opens in ("mark", "lower"):
        return NEVER, 0.0
    if stops != ".":
        return (0.0, SKIP_CLEAR) if not alone else (END_DOUBT, 1.0)
    word = _abbreviation(s, at, lo)
    if word in MAY_END:
        if closers:
            return NEVER, 0.0
        if opens == "upper" and german:
            first = WORD.match(s, WORD_START.match(s, SPACE.match(s, m.end()).end()).end())
            return (0.0, SKIP_CLEAR) if first and first[0].lower() in GERMAN_OPENERS else (NEVER, 0.0)
        return (0.0, SKIP_CLEAR) if opens in ("upper", "name", "number") else (NEVER, 0.0)
    if word in GOES_ON or len(word) == 1 and word.isalpha():
        return NEVER, 0.0
    if word.isdigit() and opens == "lower":
        return NEVER, 0.0
    if opens == "mark":
        return END_DOUBT, 2.0 if s[SPACE.match(s, m.end()).end()] not in "–—-,;:" else 0.0
    return 0.0, SKIP_CLEAR


class _Node(NamedTuple):
    """A mark at which a sentence may end, with the pairs that stay open beyond it, outermost first."""

    to: int
    end: float
    go: float
    open: tuple[tuple[int, int], ...]


def _spaced(s: str, marks: list[tuple[re.Match, tuple]], start: int, german: bool) -> list[int]:
    """Ends of the cheapest path through the lattice of ``marks``; the last may be the end of the text."""
    out: list[int] = []
    part: list[_Node] = []
    lo = start
    for m, inside in marks:
        end, go = _judge(s, m, lo, german)
        if end >= NEVER:
            continue
        node = _Node(m.end(), end, go, tuple(p for p in inside if p[1] >= m.end()))
        part.append(node)
        # gather up to a mark that is clear and beyond which no pair is open
        if end == 0 and go >= SKIP_CLEAR and not node.open:
            out += [node.to] if len(part) == 1 else _cheapest(s, part, start, True)
            start, part = node.to, []
    if part:
        out += _cheapest(s, part, start, False)
    return out


def _cheapest(s: str, part: list[_Node], start: int, closed: bool) -> list[int]:
    """Ends of the cheapest path through ``part``; unless ``closed`` it goes on to the end of the text."""
    n = len(part)
    size = n if closed else n + 1
    best, back = [0.0] + [1e18] * size, [-1] * (size + 1)
    for i in range(size):
        lo = SPACE.match(s, part[i - 1].to if i else start).end()
        held = [c for o, c in part[i - 1].open if o < lo < c] if i else []
        first = run = best[i]
        for j in range(i, size):
            to, end, go, pairs = part[j] if j < n else (len(s), 0.0, 0.0, ())
            cost = run + end
            for o, _ in reversed(pairs):
                if o < lo:
                    break
                cost += CUT_PAIR + (4.0 if o > lo else 0.0)
            for c in held:
                cost += 0.5 * (c < to)
            if cost < best[j + 1]:
                best[j + 1], back[j + 1] = cost, i
            # a mark within a quotation that began inside the sentence costs nothing to run over
            if not (pairs and pairs[-1][0] > lo):
                run += go
                if run > first + GIVE_UP:
                    break
    out, j = [], size
    while j > 0:
        out.append(part[j - 1].to if j <= n else len(s))
        j = back[j]
    out.reverse()
    return out


def _prose(s: str, german: bool, known: Dictionary) -> list[tuple[int, int]]:
    """Sentences of one run of prose."""
    marks = list(CANDIDATE.finditer(s))
    cuts: list[int] = []
    if marks:
        spaced: list[tuple[re.Match, tuple]] = []

        def flush() -> None:
            if spaced:
                cuts.extend(x for x in _spaced(s, spaced, cuts[-1] if cuts else 0, german) if x < len(s))
                spaced.clear()

        for m, inside in zip(marks, _open_at(marks, quote_pairs(s))):
            if m["end"] is not None:
                spaced.append((m, inside))
                continue
            flush()
            if m["thai"] is not None or _east_end(s, m, inside, cuts[-1] if cuts else 0, known):
                cuts.append(m.end())
        flush()
    elif EAST_RUN.search(s):
        cuts = _markless(s, known)
    out, lo = [], 0
    for hi in [*cuts, len(s)]:
        part = s[lo:hi]
        a, b = lo + len(part) - len(part.lstrip()), lo + len(part.rstrip())
        if a < b:
            out.append((a, b))
        lo = hi
    return out


def _blocks(text: str, lines: list[tuple[int, int, int]], out: list[tuple[int, int]], german: bool, known: Dictionary, level: int = 0) -> None:
    """Sentences of ``lines`` (start, content start, end), whose markers before the content are left out."""
    para: list[tuple[int, int, int]] = []

    def flush() -> None:
        if para:
            a, b = para[0][1], para[-1][2]
            if len(para) == 1:
                s = text[a:b]
            else:
                bits = [text[a:para[0][2]]]
                for (_, _, end), (lo, cont, hi) in zip(para, para[1:]):
                    bits += [text[end:lo], " " * (cont - lo), text[cont:hi]]
                s = "".join(bits)
            out.extend((a + x, a + y) for x, y in _prose(s, german, known))
            para.clear()

    def whole(a: int, b: int) -> None:
        part = text[a:b]
        x, y = a + len(part) - len(part.lstrip()), a + len(part.rstrip())
        if x < y:
            out.append((x, y))

    i, n, listed = 0, len(lines), False
    while i < n:
        lo, cont, hi = lines[i]
        body = text[cont:hi]
        if not body or body.isspace():
            flush()
            listed = False
            i += 1
            continue
        ch = body.lstrip()[0]
        if ch in "`~" and (f := FENCE.match(body)):
            flush()
            j = i + 1
            while j < n and not text[lines[j][1]:lines[j][2]].strip().startswith(f[1]):
                j += 1
            j = min(j, n - 1)
            whole(cont, lines[j][2])
            i, listed = j + 1, False
            continue
        if not ch.isalnum() and RULE.match(body):
            flush()
            i += 1
            continue
        if level < LEVELS and ch in ">/-|;%#*" and (p := PREFIX.match(text, cont, hi)):
            sign = next(g for g in p.groups() if g)
            j = i
            part = []
            while j < n and (q := PREFIX.match(text, lines[j][1], lines[j][2])) and next(g for g in q.groups() if g) in (sign, "*/"):
                part.append((lines[j][0], q.end(), lines[j][2]))
                j += 1
            if sign == "/*":
                while j < n and not part[-1:][0][2] - 2 == text.find("*/", part[-1][0], part[-1][2]) and text[lines[j][1]:lines[j][2]].strip():
                    q = PREFIX.match(text, lines[j][1], lines[j][2])
                    part.append((lines[j][0], q.end() if q else lines[j][1], lines[j][2]))
                    j += 1
            if sign != "#" or len(part) > 1:
                flush()
                _blocks(text, part, out, german, known, level + 1)
                i, listed = j, False
                continue
        if ch in "#=" and (h := HEADING.match(body)):
            flush()
            whole(cont + h.end(), hi)
            i, listed = i + 1, False
            continue
        if (ch in "-*+•‣◦" or ch.isdigit()) and (m := LIST.match(body)) and (not para or listed or not m[1] or m[1] == "1"):
            flush()
            j = i + 1
            while j < n and text[lines[j][1]:lines[j][2]].strip() and not LIST.match(text[lines[j][1]:lines[j][2]]) and not HEADING.match(text, lines[j][1], lines[j][2]) \
                    and not FENCE.match(text, lines[j][1], lines[j][2]) and not PREFIX.match(text, lines[j][1], lines[j][2]):
                j += 1
            whole(cont + m.end(), lines[j - 1][2])
            i, listed = j, True
            continue
        listed = False
        para.append((lo, cont, hi))
        i += 1
    flush()


LINE = re.compile(r"[^\r\n\v\f\x85  ]*(?:\r\n|[\r\n\v\f\x85  ]|$)")
_GERMAN = re.compile(r"\b(?:der|die|das|und|nicht|usw|bzw|den|dem)\b")


def sentence_spans(text: str, known: Dictionary | None = None) -> list[tuple[int, int]]:
    """(start, end) of the sentences in code points, end exclusive. Blank texts have none."""
    if not text or text.isspace():
        return []
    lines, at = [], 0
    for line in text.splitlines(keepends=True):
        end = at + len(line)
        lines.append((at, at, at + len(line.rstrip("\r\n\v\f\x1c\x1d\x1e\x85  "))))
        at = end
    out: list[tuple[int, int]] = []
    _blocks(text, lines, out, bool(_GERMAN.search(text)), known or dictionary())
    return out


def sentences(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, start_char, end_char) of the sentences of every text.

    Null ids and null, empty or blank texts have no row; repeated rows of an id give their
    sentences once; an empty table gives no rows. Whole texts are read whatever their length.
    ``vocabulary`` is the file of the dictionary, read on the driver (about a megabyte).
    """
    raw = documents.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Dictionary(raw.value)
        for batch in batches:
            ids, starts, ends = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i is None or not text:
                    continue
                for a, b in sentence_spans(text, known):
                    ids.append(i)
                    starts.append(a)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["doc_id", "start_char", "end_char"])

    ship(documents.sparkSession)
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, "doc_id long, start_char long, end_char long").distinct()
