"""Natural language in the comments and string literals of code.

Comments and literals are taken out by a scanner of the code's real language. Each is cut
into words, or for Chinese and Japanese, written without spaces, into clauses. A dynamic program labels them with
languages: every word or clause has a score in every language of its script, a change of language costs a penalty, and the
labelling of least cost is the segmentation, so a stray name inside a sentence doesn't break it, and a clause of Chinese
characters alone is Japanese in Japanese surroundings. Code words
(names with signs or digits, paths, calls) are set aside first; two in a row end a run of text.
Segment bytes, with what stands between the words of a segment, are summed by file and language. However short, every comment
and literal counts; a lone word counts where it is the whole of one, as beside code or other scripts it is a stray name.

Scores of words are those of a character-trigram model with a word list, by language; scores of clauses those of characters and
their pairs. All are trained on bounded samples of labelled texts, together with a gibberish model that stands for "no language".
Text in another language of the Cyrillic script, told by its letters, or in another script is "other".
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.session import ship

LATIN = ("en", "de", "fr", "es")
SPACED, EASTERN = (*LATIN, "ru"), ("zh", "ja")
LANGUAGES = (*SPACED, *EASTERN)
#: Labelled texts the scores are trained on, at most: of the Latin script, and of all others.
SAMPLE = 3_000
#: Words of that sample that reach the model, at most.
WORDS = 200_000
#: Price of a change of language between two words, in nats.
SWITCH = 16.0
#: Nats a letter of a word costs in no language at all.
GIBBERISH = 5.0
#: Nats that a Cyrillic word costs more in Russian for a letter Russian hasn't, and in another language for none.
FOREIGN, NATIVE = 12.0, 2.0
#: Nats of a character that was never met in Chinese or Japanese, of kana in Chinese, and of a Japanese clause without kana.
UNSEEN, KANA_IN_CHINESE, NO_KANA = 11.0, 16.0, 8.0
MIN_WORDS, MIN_CHARS = 6, 12
REMEMBER = 100_000

# Frequent small words, for languages that the sample lacks.
SMALL = {
    "en": "the of and to in is that it for was on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than been its who now my made over did down only way find use may",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei wenn ob weil diese dieser",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec mais comme on ou si leur nous être fait cette ses aux son entre sans vers quand lorsque dont où tout elle été",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está",
}

# Accented letters that each language is written with.
ACCENTED = {"en": "", "de": "äöüß", "fr": "àâæçèéêëîïôœùûüÿ", "es": "áéíñóúü"}

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
EAST = re.compile("[぀-ヿ㐀-鿿豈-﫿ｦ-ﾝ]")
EAST_RUN = re.compile("[぀-ヿ㐀-鿿豈-﫿ｦ-ﾝ]+")
KANA = re.compile("[぀-ヿｦ-ﾝ]")
CLAUSE = re.compile("[^。！？!?\n]+[。！？!?\n]*")
CYRILLIC = re.compile("[Ѐ-ӿ]")
NOT_RUSSIAN = re.compile("[^Ѐ-ӿ]|[^а-яёА-ЯЁ]")
OTHER_SCRIPT = re.compile("[\u0370-\u03ff\u0530-\u109f\u10a0-\u13ff\u1780-\u17ff\u1c80-\u1cff\uac00-\ud7af]")
# vowel signs belong to the words of the Indic and Thai scripts
OTHER_WORD = re.compile("[\u0370-\u03ff\u0530-\u109f\u10a0-\u13ff\u1780-\u17ff\u1c80-\u1cff\uac00-\ud7af]+")
CODE = re.compile(r"[_\\=<>{}@$%^&~|]|::|->|\w[./:]\w|/\w|\w\(|\w\[|[a-zà-ÿ][A-Z]|\d|^[A-Z]{2,}-[A-Z]{2,}(?:-\w+)*:?$")
# tags of editors, which are no words
MARKERS = re.compile(r"\b(?:TODO|FIXME|XXX)\b")
_C_STRING = r"\"(?:[^\"\\\n]|\\.)*\""
SCANNERS = {
    "python": re.compile(r"(?P<c>#[^\n]*(?:\n[ \t]*#[^\n]*)*)|(?P<s>\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|" + _C_STRING + r"|'(?:[^'\\\n]|\\.)*')", re.S),
    "script": re.compile(r"(?P<c>//[^\n]*(?:\n[ \t]*//[^\n]*)*|/\*.*?(?:\*/|\Z))|(?P<s>" + _C_STRING + r"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)", re.S),
    "plain": re.compile(r"(?P<c>//[^\n]*(?:\n[ \t]*//[^\n]*)*|/\*.*?(?:\*/|\Z))|(?P<s>\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*\"\"\"|" + _C_STRING + r"|`[^`]*`)|'(?:\\[^\n]|[^'\\\n])'", re.S),
}
PYTHONIC = re.compile(r"^(?:from [\w.]+ import |import \w[\w.]*(?:$|\r| as |,)|(?:class|def) \w.*:\s*$|\s+(?:def \w.*:|elif .*:|pass)\s*$)", re.M)
BRACED = re.compile(r"^(?:use [\w:{}, ]+;|package [\w.]+;?\s*$|import .* from |import [\w.]+;|(?:pub(?:\(\w+\))? |export |async function |const |let |var |func |fn |impl |function |public |final |static |class \w+ ?(?:extends .*)?\{))", re.M)
RUSTIC = re.compile(r"^(?:use (?:crate|std|super)::|(?:pub(?:\(\w+\))? )?(?:fn|impl|mod) )|^package \w+\s*$|^func ", re.M)
FAMILY = {"py": "python", "js": "script", "ts": "script", "rs": "plain", "go": "plain", "java": "plain"}


def family(extension: str, text: str) -> str | None:
    """Which scanner reads the text: that of the extension, unless the text is plainly of another kind."""
    if text.lstrip("﻿ \t\r\n")[:1] == "<":
        return None
    kind = FAMILY.get(extension)
    python, braced = bool(PYTHONIC.search(text)), bool(BRACED.search(text))
    if kind == "python":
        if braced and not python:
            return "plain" if RUSTIC.search(text) else "script"
        return kind
    if python and not braced:
        return "python"
    if kind is None:
        return None
    if kind == "script" and RUSTIC.search(text):
        return "plain"
    return kind


class Scores(dict):
    """Costs of a word in each language of its script and in none, by trigrams and word lists: for the Latin script those of
    ``LATIN`` and none, for the Cyrillic one Russian, another language and none."""

    def __init__(self, model: dict) -> None:
        super().__init__()
        self.words, self.grams, self.totals, self.signs = model["words"], model["grams"], model["totals"], model["signs"]

    def cost(self, word: str, lang: str) -> float:
        w = f"^{word}$"
        grams, (n_words, _) = self.grams[lang], self.totals[lang]
        p = 0.0
        for i in range(len(w) - 2):
            tri = w[i:i + 3]
            p += math.log((grams.get(tri, 0) + 0.05) / (grams.get(tri[:2], 0) + 0.05 * 60))
        listed = self.words[lang].get(word, 0) / n_words if n_words else 0.0
        return -math.log(0.5 * listed + 0.5 * math.exp(max(p, -300.0)) + 1e-130)

    def __missing__(self, word: str) -> tuple[float, ...]:
        if len(self) > REMEMBER:
            self.clear()
        none = GIBBERISH * (len(word) + 1)
        if CYRILLIC.search(word):
            foreign = NOT_RUSSIAN.search(word) is not None
            c = min(self.cost(word, "ru"), none - 1.0)
            v = self[word] = (c + FOREIGN * foreign, c + NATIVE * (not foreign), none + FOREIGN)
            return v
        out = []
        for lang in LATIN:
            strange = sum(x > "\x7f" and x.isalpha() and x not in ACCENTED[lang] for x in word)
            out.append(GIBBERISH * strange + self.cost(word, lang))
        out.append(none)
        v = self[word] = tuple(out)
        return v

    def clause(self, letters: str) -> tuple[float, float]:
        """Costs of a clause in Chinese and in Japanese."""
        out = []
        for lang in EASTERN:
            one, two, total = self.signs[lang]
            c = 0.0
            for i, ch in enumerate(letters):
                if lang == "zh" and KANA.match(ch):
                    c += KANA_IN_CHINESE
                    continue
                n = one.get(ch, 0)
                p = n / total if total else 0.0
                if i and (m := one.get(letters[i - 1], 0)):
                    p = 0.5 * p + 0.5 * two.get(letters[i - 1:i + 1], 0) / m
                c += min(UNSEEN, -math.log(p + 1e-9)) if total else 6.0
            out.append(c)
        return out[0], out[1] + NO_KANA * (not KANA.search(letters))


def counted(rows: list[tuple[str, str]]) -> list[tuple[str, str, int]]:
    """(language, word or pair of characters, count) of (language, text) pairs."""
    c: Counter = Counter()
    for lang, text in rows:
        if lang in EASTERN:
            c.update((lang, run[i:i + 2]) for run in EAST_RUN.findall(text) for i in range(len(run) - 1))
        else:
            c.update((lang, w) for w in WORD.findall(text.lower()))
    return [(lang, w, n) for (lang, w), n in c.items()]


def train(counts: list[tuple[str, str, int]]) -> dict:
    """The model of (language, word or pair of characters, count) rows."""
    words: dict[str, Counter] = {k: Counter() for k in SPACED}
    pairs: dict[str, Counter] = {k: Counter() for k in EASTERN}
    for lang, w, n in counts:
        if lang in pairs:
            pairs[lang][w] += n
        elif lang in words and not EAST.search(w) and bool(CYRILLIC.search(w)) == (lang == "ru"):
            words[lang][w] += n
    for lang in LATIN:
        # a word mostly met under another label is noise of the labels
        words[lang] = Counter({w: c for w, c in words[lang].items() if c >= 2 and c * 4 >= max(words[k].get(w, 0) for k in LATIN)})
        for w in SMALL[lang].split():
            words[lang][w] += 20
    grams: dict[str, Counter] = {}
    for lang in SPACED:
        g = grams[lang] = Counter()
        for w, c in words[lang].items():
            x, c = f"^{w}$", 1 + math.log(c)
            for i in range(len(x) - 2):
                g[x[i:i + 3]] += c
                g[x[i:i + 2]] += c
    signs = {}
    for lang, two in pairs.items():
        one: Counter = Counter()
        for w, c in two.items():
            # kana under a Chinese label are wrong labels
            if lang == "ja" or not KANA.search(w):
                one[w[0]] += c
        signs[lang] = (dict(one), dict(two), sum(one.values()))
    return {"words": {k: dict(v) for k, v in words.items()}, "grams": {k: dict(v) for k, v in grams.items()}, "totals": {k: (sum(words[k].values()), sum(grams[k].values())) for k in SPACED},
            "signs": signs}


def best_labels(costs: list[tuple[float, ...]], switch: float = SWITCH) -> list[int]:
    """The labelling of least cost: one cost a word and label, ``switch`` for every change."""
    k = len(costs[0])
    first = min(range(k), key=costs[0].__getitem__)
    if all(c[first] == min(c) for c in costs):
        return [first] * len(costs)
    total, back = list(costs[0]), []
    for c in costs[1:]:
        at = min(range(k), key=total.__getitem__)
        leap = total[at] + switch
        step = [j if total[j] <= leap else at for j in range(k)]
        total = [(total[j] if total[j] <= leap else leap) + c[j] for j in range(k)]
        back.append(step)
    j = min(range(k), key=total.__getitem__)
    out = [j]
    for step in reversed(back):
        j = step[j]
        out.append(j)
    return out[::-1]


def _size(s: str) -> int:
    """Bytes of a piece of text, white space between words counting one."""
    s = " ".join(s.split())
    return len(s) if s.isascii() else len(s.encode("utf-8", "surrogatepass"))


def _gap(s: str) -> int:
    """Bytes of what stands between two words."""
    return 1 if s.isspace() else _size(s) + (s[:1].isspace() + s[-1:].isspace() if s else 0)


CHUNK = re.compile(r"\S+")


def spans(text: str, scores: Scores) -> list[tuple[str, int, int]]:
    """(language, units, bytes) of the runs of text in one comment or literal; units are words, or letters in zh and ja."""
    out: list[tuple[str, int, int]] = []
    if EAST.search(text):
        clauses = [(m[0], letters) for m in CLAUSE.finditer(text) if (letters := "".join(EAST.findall(m[0])))]
        last = -1
        for (whole, letters), label in zip(clauses, best_labels([scores.clause(x) for _, x in clauses])):
            size = len("".join(x for x in whole if x > "\x7f").encode("utf-8", "surrogatepass"))
            if label == last:
                out[-1] = (out[-1][0], out[-1][1] + len(letters), out[-1][2] + size)
            else:
                out.append((EASTERN[label], len(letters), size))
            last = label
    if OTHER_SCRIPT.search(text):
        found = OTHER_WORD.findall(text)
        out.append(("other", len(found), sum(len(w.encode()) for w in found)))
        text = OTHER_WORD.sub(" ", text)
    words: list[str] = []
    gaps: list[bool] = []
    # of each word: its own bytes, and those between it and the one before, if no code is
    sizes: list[int] = []
    between: list[int] = []
    code, alone, end = 2, True, -1
    for chunk in CHUNK.finditer(text):
        part, at = chunk[0], chunk.start()
        if CODE.search(part):
            code += 1
            alone = False
            end = -1
            continue
        for m in WORD.finditer(part):
            w = m[0]
            if EAST.search(w):
                code = 2
                alone = False
                end = -1
                continue
            words.append(w.lower())
            gaps.append(code >= 2)
            sizes.append(len(w) if w.isascii() else len(w.encode("utf-8", "surrogatepass")))
            between.append(_gap(text[end:at + m.start()]) if end >= 0 else 0)
            end = at + m.end()
            code = 0
    alone = alone and len(words) == 1 and not MARKERS.search(text)

    def put(lang: str, i: int, j: int) -> None:
        out.append((lang, j - i, sum(sizes[i:j]) + sum(between[i + 1:j])))

    at = 0
    while at < len(words):
        end = at + 1
        cyr = bool(CYRILLIC.search(words[at]))
        while end < len(words) and not gaps[end] and bool(CYRILLIC.search(words[end])) == cyr:
            end += 1
        if cyr or end - at >= 2 or alone:
            names = ("ru", "other") if cyr else LATIN
            labels = best_labels([scores[w] for w in words[at:end]])
            i = 0
            while i < len(labels):
                j = i
                while j < len(labels) and labels[j] == labels[i]:
                    j += 1
                if labels[i] < len(names):
                    put(names[labels[i]], at + i, at + j)
                i = j
        at = end
    return out


TAG = re.compile(r"[^\n]*\bSPDX-[\w-]+:[^\n]*")
MARKS = re.compile(r"^[ \t]*(?:#+!?|//[/!]*|/\*+!?|\*+/?|\*)[ \t]?", re.M)


def texts_of(extension: str, text: str) -> Iterator[tuple[str, str]]:
    """(kind, text) of the comments and literals, without their signs; names and queries in literals are left out."""
    kind = family(extension, text)
    if kind is None:
        return
    for m in SCANNERS[kind].finditer(text):
        s = m["c"]
        if s is not None:
            yield "comment", MARKS.sub(" ", TAG.sub("", s) if "SPDX-" in s else s)
        elif m["s"] is not None:
            s = m["s"].strip("\"'`")
            if not NAME.fullmatch(s) and not STATEMENT.match(s):
                yield "string", s.replace("\\n", "\n").replace("\\t", " ")


# names of parts joined by signs, as in log-level or a,b
NAME = re.compile(r"[!-~]*[A-Za-z][!-&(-@\[-`{-~]+[A-Za-z][!-~]*")
STATEMENT = re.compile(r"\s*(?:SELECT\b.*\bFROM|INSERT\s+INTO|UPDATE\s+\S+\s+SET|DELETE\s+FROM|(?:CREATE|ALTER|DROP)\s+(?:TABLE|INDEX|VIEW)|WITH\s+\w+\s+AS\s*\()\b", re.S)

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("nat_lang", T.StringType()), T.StructField("bytes", T.LongType()), T.StructField("share", T.DoubleType()),
                       T.StructField("spans", T.IntegerType()), T.StructField("longest", T.IntegerType())])


def word_counts(documents: DataFrame, sample: int = SAMPLE, most: int = WORDS) -> list[tuple[str, str, int]]:
    """(language, word or pair of characters, count) of the ``most`` commonest in bounded samples, drawn by a hash of the id, of
    texts with a usable label. Counting is done by the executors; null labels, texts and ids take no part."""
    lang = F.substring(F.lower("lang"), 1, 2)
    fit = documents.filter(lang.isin(*LANGUAGES)).select("doc_id", lang.alias("lang"), "text").filter("length(text) > 0")
    latin = F.col("lang").isin(*LATIN)
    total = fit.agg(F.count(F.when(latin, 1)).alias("a"), F.count(F.when(~latin, 1)).alias("b")).first()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    part = fit.filter(draw < F.when(latin, int(1_000_000 * min(1.0, sample / max(total[0], 1)))).otherwise(int(1_000_000 * min(1.0, sample / max(total[1], 1)))))
    word = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+(?:['’]\p{L}+)*"), F.lit(0))
    pair = F.regexp_extract_all("text", F.lit(f"(?=({EAST.pattern}{{2}}))"), F.lit(1))
    words = part.select("lang", F.explode(F.when(F.col("lang").isin(*EASTERN), pair).otherwise(word)).alias("w"))
    counts = words.groupBy("lang", "w").agg(F.count("*").alias("n")).filter("n > 1")
    rows = [r for own in (latin, ~latin) for r in counts.filter(own).orderBy(F.desc("n"), "lang", "w").limit(most).collect()]
    return [(r[0], r[1], r[2]) for r in rows]


def languages(files: DataFrame, model: dict, id_col: str = "id", path_col: str = "file_path", text_col: str = "content") -> DataFrame:
    """(id, nat_lang, bytes, share, spans, longest): natural language by file.

    ``share`` is of the bytes of the whole file; ``longest`` is the longest run, in words, or letters in
    zh and ja. Null ids and null or empty texts have no row, nor have files of unknown extension, web pages and
    files without running text. Text that is in none of the seven languages is "other". A repeated id has its rows once for each row of the table.
    """
    shared = files.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        scores, known = Scores(shared.value), {}
        for batch in batches:
            rows: list[tuple] = []
            for i, path, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if i is None or not text:
                    continue
                ext = (path or "").rpartition(".")[2].lower()
                raw = text.encode("utf-8", "surrogatepass")
                key = (ext, xxh3_128_digest(raw))
                found = known.get(key)
                if found is None:
                    if len(known) > REMEMBER:
                        known.clear()
                    sums: dict[str, list[int]] = {}
                    for _, s in texts_of(ext, text):
                        for lang, units, size in spans(s, scores):
                            t = sums.setdefault(lang, [0, 0, 0])
                            t[0] += size
                            t[1] += 1
                            t[2] = max(t[2], units)
                    found = known[key] = [(k, a, a / len(raw), b, c) for k, (a, b, c) in sums.items()]
                rows += [(i, *x) for x in found]
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.float64(), pa.int32(), pa.int32()))], names=SCHEMA.names)

    ship(files.sparkSession)
    return files.select(*(F.col(c).cast("string") for c in (id_col, path_col, text_col))).mapInArrow(work, SCHEMA)


def running_text(rows: DataFrame) -> DataFrame:
    """(id, nat_lang) where one comment or literal holds six words in a row, or twelve letters of zh or ja, in one of the seven languages."""
    rows = rows.filter(F.col("nat_lang").isin(*LANGUAGES))
    least = F.when(F.col("nat_lang").isin("zh", "ja"), MIN_CHARS).otherwise(MIN_WORDS)
    return rows.filter(F.col("longest") >= least).select("id", "nat_lang").distinct()
