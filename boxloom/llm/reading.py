"""Reading levels: smoothed unigram models per language and grade, over the prose of each text.

Prose is what is left without markup, headings, lists of names, logs, tables, configuration, code and label lines.
Models are trained on all graded texts, on top of a prior of fixed weight from all texts, which a readability formula
puts at a grade. Each passage (the lines between two blank lines) has a likelihood under every grade; the shares of the
grades in a text are those of highest posterior likelihood (a mixture fitted by expectation maximisation), so a text
with passages of two levels is told from one in between. The level of a text is the grade that holds most of its prose.

A declared code counts as a language if held-out texts declared so are likelier under it than under any code that is
declared more often.

No text is left out of any of this. Texts are parsed once and their terms kept packed; words are counted in the tasks and
summed in Spark, so what the driver gets and tasks share is one row per term, language and grade of the corpus.

Defined results: null, blank and prose-free texts have level null. A text graded twice counts with half its weight
per grade. A text most of whose words no model knows is in none of the languages: language and level are null. Without
any texts to train on there are no levels.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.operators.ranking import running
from boxloom.runtime import settle

GRADES = (1, 2, 3, 4, 5)
#: Words that the formula-graded texts of a language and grade weigh together, however many there are.
PRIOR_WORDS = 500.0
#: A text is in a language if its model knows this share of the words at least.
LEAST_KNOWN = 0.4
SMOOTHING = 0.05
#: Texts that are worked on at once, which bounds the arrays, and sums that a task holds before it hands them on.
BLOCK = 256
MOST_HELD = 500_000

_TAG = re.compile(r"<[^<>\n]{1,200}>")
_GAP = re.compile(r"\n[ \t]*\n")
_FENCE = re.compile(r"\s*(?:```|~~~)")
_NOT_PROSE = re.compile(
    r"\s*(?:#"  # heading
    r"|\|"  # table row
    r"|(?:[-=_*]\s?){3,}\s*$"  # rule
    r"|Traceback\b|File \""  # stack trace
    r"|\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d"  # log line
    r"|[\w./-]+=[^\s=]*(?:[;,\s]|$)"  # key=value
    r"|[\w.-]+:(?:\s*$|\s+(?:\S+|\[.*\]|\{.*\})\s*$)"  # key: value
    r"|(?:[-+]?\d[\d.eE+-]*[\s,;]+){3,}[-+]?\d[\d.eE+-]*\s*$"  # numbers only
    r"|(?:import|from|def|class|return)\s\S+.*[:()]\s*$"  # code
    r")"
)
_ITEM = re.compile(r"\s*(?:([-*•+])|(\d{1,3})[.)])\s+")
_END = re.compile(r"[.!?。！？…:：;；][\s\"”’')\]）」]*$")
_HAN = re.compile(r"[㐀-鿿]")
_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*|\d+(?:[.,]\d+)*")
#: The same for lower-case ASCII, where a plain range is found faster.
_ASCII_WORD = re.compile(r"[a-z]+(?:[-'][a-z]+)*|[0-9]+(?:[.,][0-9]+)*")
#: Signs without width: zero-width blank and joiner, soft hyphen, byte order mark.
_NO_WIDTH = ("\u200b", "\u200d", "\xad", "\ufeff")
_SENTENCE = re.compile(r"[.!?。！？]+")


def passages(text: str | None) -> list[str]:
    """The prose of a text, one string per passage."""
    if not text:
        return []
    text = html.unescape(_TAG.sub("\n", text)) if ("<" in text or "&" in text) else text
    text = text.replace("\r\n", "\n").replace("\r", "\n").replace("\xa0", " ")
    for sign in _NO_WIDTH:
        text = text.replace(sign, "")
    out, fenced = [], False
    for block in _GAP.split(text):
        lines = []
        for line in block.split("\n"):
            if _FENCE.match(line):
                fenced = not fenced
            elif not fenced and line.strip() and not _NOT_PROSE.match(line):
                lines.append(line)
        kept = []
        for i, line in enumerate(lines):
            item = _ITEM.match(line)
            body = line[item.end() :] if item else line
            ended = bool(_END.search(body))
            if not ended:
                words = len(body) // 2 if _HAN.search(body) else len(body.split())
                if item and (item.group(2) or words < 3):
                    continue  # a numbered heading, or a name in a list
                if not item and words <= 4 and not kept and (len(lines) == 1 or i == 0):
                    continue  # a heading line
            kept.append(body.strip())
        if kept:
            out.append("\n".join(kept))
    return out


def terms(passage: str) -> list[str]:
    """Lower-case words, numbers as one term, and pairs of neighbouring signs for text without blanks between words."""
    return _as_terms(_words(passage), passage)


def _words(passage: str) -> list[str]:
    passage = passage.lower()
    return (_ASCII_WORD if passage.isascii() else _WORD).findall(passage)


def _as_terms(words: list[str], passage: str) -> list[str]:
    if passage.isascii() or not _HAN.search(passage):
        return ["0" if word[0].isdigit() else word for word in words]
    out = []
    for word in words:
        if word[0].isdigit():
            out.append("0")
        elif word[0] >= "㐀" and _HAN.search(word):
            out += [word[i : i + 2] for i in range(len(word) - 1)] or [word]
        else:
            out.append(word)
    return out


def formula_score(parts: list[str], words: list[str]) -> float:
    """A readability formula without word lists: words per sentence plus the share of long words in percent."""
    if not words:
        return 0.0
    text = " ".join(parts)
    sentences = max(1, len(list(filter(str.strip, _SENTENCE.split(text)))))
    if _HAN.search(text):
        return len(_HAN.findall(text)) / sentences
    return len(words) / sentences + 100 * sum(map((6).__lt__, map(len, words))) / len(words)


def pack(text: str | None) -> tuple[bytes | None, float | None]:
    """(the terms of the prose, a line per passage; its formula score), both null without prose."""
    parts = passages(text)
    words = list(map(_words, parts))
    lines = [" ".join(_as_terms(w, p)) for p, w in zip(parts, words) if w]
    if not lines:
        return None, None
    return zlib.compress("\n".join(lines).encode(), 1), formula_score(parts, [x for w in words for x in w])


def unpack(packed: bytes | None) -> list[list[str]]:
    """The terms of each passage."""
    return [line.split(" ") for line in zlib.decompress(packed).decode().split("\n")] if packed else []


def _bag(packed: bytes) -> Counter:
    return Counter(zlib.decompress(packed).decode().split())


class _Index(dict):
    """Term -> row; unknown terms have row 0."""

    def __missing__(self, term: str) -> int:
        return 0


class Model:
    """Log probabilities of terms by language, and within a language by grade.

    Each language has the terms of its own texts only: a term is a row, and a row has one entry per language that has
    the term, so the model grows with the vocabularies and not with their product. Row 0 stands for terms that no
    training text has. A grade without training texts in a language can't be chosen.
    """

    def __init__(self, counts: dict[tuple[str, int], dict[str, float]]) -> None:
        self.languages = sorted({lang for lang, _ in counts})
        self.index = _Index({w: i + 1 for i, w in enumerate(sorted(set().union(*counts.values())))})
        n, g, rows = len(self.languages), len(GRADES), len(self.index) + 1
        place = {lang: at for at, lang in enumerate(self.languages)}
        # an entry is a row and a language that has its term; its number is row * n + language
        numbers = [np.fromiter(map(self.index.__getitem__, words), np.int64, len(words)) * n + place[lang] for (lang, _), words in counts.items()]
        keys, entry = np.unique(np.concatenate([*numbers, np.zeros(0, np.int64)]), return_inverse=True)
        grade = np.repeat([g - 1 for _, g in counts], [len(words) for words in counts.values()]).astype(np.int64)
        table = np.bincount(entry * g + grade, np.fromiter((k for words in counts.values() for k in words.values()), float, len(entry)), len(keys) * g).reshape(-1, g)
        self.entry_lang = (keys % n).astype(np.int32)
        self.first = np.searchsorted(keys // n, np.arange(rows + 1)).astype(np.int64)
        of_lang = np.bincount(self.entry_lang, table.sum(axis=1), n)
        rest = np.log(of_lang + SMOOTHING * rows)
        self.unseen = np.log(SMOOTHING) - rest
        self.more = (np.log(table.sum(axis=1) + SMOOTHING) - rest[self.entry_lang] - self.unseen[self.entry_lang]).astype(np.float32)
        # within a language only its own vocabulary is smoothed
        own = np.bincount(self.entry_lang, minlength=n) + 1
        total = np.stack([np.bincount(self.entry_lang, table[:, k], n) for k in range(g)], axis=1)
        rest = np.log(total + SMOOTHING * own[:, None])
        self.unseen_grade = np.where(total > 0, np.log(SMOOTHING) - rest, -1e3)
        self.more_grade = np.where(total[self.entry_lang] > 0, np.log(table + SMOOTHING) - np.log(SMOOTHING), 0.0).astype(np.float32)
        # shares of the grades in what was learnt, where the fit of a text begins
        self.prior = (total + 1) / (total + 1).sum(axis=1, keepdims=True)

    def _entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``rows``, entry) of all entries of the given rows."""
        n = self.first[rows + 1] - self.first[rows]
        at = np.repeat(np.arange(len(rows)), n)
        return at, np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + self.first[rows][at]

    def tell(self, rows: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, share of words that it knows, likelihoods) of ``n`` texts, from ``rows`` with ``weights`` that belong to texts ``owner``."""
        at, entry = self._entries(rows)
        langs = len(self.languages)
        words = np.bincount(owner, weights, n)
        place = owner[at] * langs + self.entry_lang[entry]
        score = words[:, None] * self.unseen + np.bincount(place, weights[at] * self.more[entry], n * langs).reshape(n, langs)
        known = np.bincount(place, weights[at], n * langs).reshape(n, langs)
        lang = score.argmax(axis=1)
        return lang, known[np.arange(n), lang] / np.maximum(words, 1e-9), score

    def read(self, texts: list[list[str]]) -> tuple[list[str | None], np.ndarray, np.ndarray]:
        """Language, shares of the grades and words of prose of each text, given as passages."""
        return self.read_terms([list(map(terms, parts)) for parts in texts])

    def read_terms(self, texts: list[list[list[str]]]) -> tuple[list[str | None], np.ndarray, np.ndarray]:
        """The same of texts given as the terms of each passage.

        All passages of a call are worked on at once. Shares are weighted by words and fitted by expectation
        maximisation: a passage belongs to the grades by likelihood times the text's shares.
        """
        listed, of_text = [], []
        for t, parts in enumerate(texts):
            for words in parts:
                if words:
                    listed.append(list(map(self.index.__getitem__, words)))
                    of_text.append(t)
        n, p = len(texts), len(listed)
        shares, words = np.full((n, len(GRADES)), np.nan), np.zeros(n, dtype=np.int64)
        if not p:
            return [None] * n, shares, words
        lengths = np.fromiter(map(len, listed), np.int64, p)
        flat = np.fromiter((r for rows in listed for r in rows), np.int64, int(lengths.sum()))
        owner, passage = np.array(of_text), np.repeat(np.arange(p), lengths)
        np.add.at(words, owner, lengths)
        lang, known, _ = self.tell(flat, np.ones(len(flat)), owner[passage], n)
        at, entry = self._entries(flat)
        mine = self.entry_lang[entry] == lang[owner[passage[at]]]
        at, entry = passage[at[mine]], entry[mine]
        logs = lengths[:, None] * self.unseen_grade[lang[owner]]
        logs += np.stack([np.bincount(at, self.more_grade[entry, k], p) for k in range(len(GRADES))], axis=1)
        like = np.exp(logs - logs.max(axis=1, keepdims=True))
        share = self.prior[lang]
        for _ in range(25):
            post = like * share[owner]
            post *= (lengths / post.sum(axis=1))[:, None]
            new = np.zeros_like(share)
            np.add.at(new, owner, post)
            new = new / np.maximum(words, 1)[:, None] + 1e-9
            new /= new.sum(axis=1, keepdims=True)
            done = np.abs(new - share).max() < 1e-6
            share = new
            if done:
                break
        told = (words > 0) & (known >= LEAST_KNOWN)
        shares[told] = share[told]
        return [self.languages[k] if ok else None for k, ok in zip(lang, told)], shares, words


def _declared(lang: Column) -> Column:
    """The language code that a row declares; null if it declares none."""
    code = F.lower(F.trim(lang))
    return F.when(code.rlike("^[a-z]{2,3}$") & ~code.isin("und", "xx", "zxx", "mul"), code)


def _texts(documents: DataFrame, grades: DataFrame) -> DataFrame:
    """``doc_id, code, half, given, words, score`` of every document, parsed once; ``given`` is null for ungraded texts, ``words`` without prose."""
    given = grades.filter(F.col("grade").between(1, 5) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.collect_list(F.col("grade").cast("int")).alias("given"))
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int")

    @F.pandas_udf("words binary, score double")
    def packed(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(list(map(pack, texts)), columns=["words", "score"]).astype({"score": float})

    # only packed terms move to the grades
    parsed = documents.select("doc_id", _declared(F.col("lang")).alias("code"), half.alias("half"), packed("text").alias("p"))
    return settle(parsed.join(given, "doc_id", "left").select("doc_id", "code", "half", "given", "p.words", "p.score"))


def _summed(rows: DataFrame, cells: Callable[[pd.DataFrame], Iterator[tuple[str, int, float, Counter]]]) -> dict[tuple[str, int], dict[str, float]]:
    """Word counts per text and number that ``cells`` gives for a batch, with the weight of each bag; summed in the tasks, then in Spark."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, int], dict[str, float]] = defaultdict(lambda: defaultdict(float))

        def flush() -> pd.DataFrame:
            out = pd.DataFrame([(*cell, w, n) for cell, words in held.items() for w, n in words.items()], columns=["name", "number", "term", "n"])
            held.clear()
            return out

        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                for name, number, weight, bag in cells(batch.iloc[at : at + BLOCK]):
                    words = held[name, number]
                    for w, n in bag.items():
                        words[w] += weight * n
                if sum(map(len, held.values())) > MOST_HELD:
                    yield flush()
        yield flush()

    summed = rows.mapInPandas(count, "name string, number int, term string, n double").groupBy("name", "number", "term").agg(F.sum("n").alias("n"))
    out: dict[tuple[str, int], dict[str, float]] = defaultdict(dict)
    for r in summed.toLocalIterator():
        out[r["name"], r["number"]][r["term"]] = r["n"]
    return dict(out)


def _blocks(model: Model, packed: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """What ``Model.tell`` says of the texts, some at a time."""
    for at in range(0, len(packed), BLOCK):
        bags = list(map(_bag, packed.iloc[at : at + BLOCK]))
        lengths = list(map(len, bags))
        flat = np.fromiter((model.index[t] for bag in bags for t in bag), np.int64, sum(lengths))
        weights = np.fromiter((n for bag in bags for n in bag.values()), float, sum(lengths))
        yield model.tell(flat, weights, np.repeat(np.arange(len(bags)), lengths), len(bags))


def _tell(rows: DataFrame, model: Model) -> Column:
    """The language of a row by its terms, null if none of the model's."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def told(words: pd.Series) -> pd.Series:
        model = shared.value
        return pd.Series([model.languages[k] if s >= LEAST_KNOWN else None for lang, share, _ in _blocks(model, words) for k, s in zip(lang, share)], dtype="object")

    return told("words")


def _as_language(counts: dict[str, dict[str, float]]) -> Model:
    return Model({(lang, GRADES[2]): words for lang, words in counts.items()})


def _languages(texts: DataFrame) -> Model | None:
    """A model of the declared codes that are languages of their own; null if no text declares any.

    From the most declared code to the least, a code is kept if most of its held-out texts are no likelier under a code
    kept before than under its own. The driver gets, code by code, how many texts are likelier under which earlier codes.
    """
    declared = texts.filter(F.col("code").isNotNull() & F.col("words").isNotNull()).select("code", "half", "words")
    halves = _summed(declared, lambda rows: ((code, half, 1.0, _bag(words)) for code, half, words in zip(rows["code"], rows["half"], rows["words"])))
    sizes = {r["code"]: r["n"] for r in texts.filter("code is not null").groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()}
    codes = sorted({code for code, _ in halves}, key=lambda c: (-sizes[c], c))
    seen = {code: words for (code, half), words in halves.items() if half == 0}
    kept = codes if len(codes) < 2 or not seen else _confirmed(declared.filter("half = 1"), [c for c in codes if c in seen], _as_language(seen))
    if not kept:
        return None
    both: dict[str, dict[str, float]] = {}
    for code in kept:
        both[code] = Counter(halves.get((code, 0), {}))
        both[code].update(halves.get((code, 1), {}))
    return _as_language(both)


def _confirmed(held: DataFrame, codes: list[str], model: Model) -> list[str]:
    """Those of ``codes``, the most declared first, that the held-out texts confirm."""
    shared = held.sparkSession.sparkContext.broadcast((model, {c: k for k, c in enumerate(codes)}, [model.languages.index(c) for c in codes]))

    @F.pandas_udf("array<int>")
    def likelier(own: pd.Series, words: pd.Series) -> pd.Series:
        model, rank, order = shared.value
        scores = (s[order] for _, _, score in _blocks(model, words) for s in score)
        return pd.Series([np.flatnonzero(s[: rank[c]] > s[rank[c]]).astype(np.int32) for c, s in zip(own, scores)], dtype="object")

    place = F.array_position(F.array(*map(F.lit, codes)), F.col("code"))
    known = held.filter(F.col("code").isin(codes)).select(place.alias("place"), likelier("code", "words").alias("likelier"))
    kept: dict[int, str] = {}
    # all rows of a code come one after another
    for place, rows in groupby(known.groupBy("place", "likelier").agg(F.count(F.lit(1)).alias("n")).orderBy("place").toLocalIterator(), key=lambda r: r["place"]):
        good = total = 0
        for r in rows:
            total += r["n"]
            good += 0 if any(k in kept for k in r["likelier"]) else r["n"]
        if good > total / 2:
            kept[place - 1] = codes[place - 1]
    return list(kept.values())


def _edges(told: DataFrame, shares: list[float]) -> dict[str, list[float]]:
    """Per language the greatest score at each grade but the last, if texts are put at grades by their rank in these shares; the middle of their ranks stands for equal scores."""
    each = settle(told.groupBy("lang", "score").agg(F.count(F.lit(1)).alias("n")))
    up_to = running(each, ["lang"], [F.col("score")], "place", {"up_to": "n"})
    total = each.groupBy("lang").agg(F.sum("n").alias("all"))
    middle = ((F.col("up_to") - F.col("n")) / F.greatest(F.col("all") - 1, F.lit(1)) + F.col("up_to") / F.col("all")) / 2
    ends = [F.coalesce(F.max(F.when(middle <= float(edge), F.col("score"))), F.lit(float("-inf"))).alias(f"e{k}") for k, edge in enumerate(np.cumsum(shares)[:-1])]
    return {r["lang"]: list(r[1:]) for r in up_to.join(total, "lang").groupBy("lang").agg(*ends).collect()}


def train(texts: DataFrame) -> Model | None:
    """A model from all texts; null if there is nothing to train on.

    First a model of languages from the declared ones, which then overrules wrong declarations; then grades, where a
    graded text gives half its weight to each of two graders' grades.
    """
    languages = _languages(texts)
    if languages is None:
        return None
    rows = texts.filter("words is not null")
    told = settle(rows.select(_tell(rows, languages).alias("lang"), "given", "words", "score")).filter("lang is not null")
    graded = told.filter("given is not null").select((1.0 / F.size("given")).alias("weight"), F.explode("given").alias("grade"))
    each = {r["grade"]: r["n"] for r in graded.groupBy("grade").agg(F.sum("weight").alias("n")).collect()}
    total = sum(each.values())
    # the formula puts texts at grades by their rank within the language, in the proportions of the graded texts
    edges = _edges(told, [(each.get(g, 0.0) + 1) / (total + len(GRADES)) for g in GRADES])

    def cells(rows: pd.DataFrame) -> Iterator[tuple[str, int, float, Counter]]:
        for lang, given, words, score in zip(rows["lang"], rows["given"], rows["words"], rows["score"]):
            bag = _bag(words)
            # grades by the formula are negative
            yield lang, -GRADES[int(np.searchsorted(edges[lang], score))], 1.0, bag
            for grade in () if given is None else given:
                yield lang, int(grade), 1.0 / len(given), bag

    counts = _summed(told, cells)
    learnt = defaultdict(dict, {cell: words for cell, words in counts.items() if cell[1] > 0})
    for (lang, grade), words in counts.items():
        if grade < 0:
            scale, cell = PRIOR_WORDS / sum(words.values()), learnt[lang, -grade]
            for w, n in words.items():
                cell[w] = cell.get(w, 0.0) + scale * n
    return Model(dict(learnt))


def levels(documents: DataFrame, grades: DataFrame) -> DataFrame:
    """``doc_id, language, level, share, prose_words``: ``share`` is the part of the prose at the level."""
    texts = _texts(documents, grades)
    model = train(texts)
    schema = "doc_id bigint, language string, level int, share double, prose_words bigint"
    if model is None:
        return documents.select("doc_id", F.lit(None).cast("string").alias("language"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("double").alias("share"), F.lit(0).cast("bigint").alias("prose_words"))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            out = []
            for at in range(0, len(batch), BLOCK):
                part = batch.iloc[at : at + BLOCK]
                langs, shares, words = known.read_terms(list(map(unpack, part["words"])))
                best = np.where(words > 0, np.nan_to_num(shares).argmax(axis=1), 0)
                for i, doc_id in enumerate(part["doc_id"]):
                    out.append((doc_id, langs[i], GRADES[best[i]], float(shares[i, best[i]]), int(words[i])) if langs[i] else (doc_id, None, None, None, int(words[i])))
            yield pd.DataFrame(out, columns=["doc_id", "language", "level", "share", "prose_words"]).astype({"level": "Int32", "prose_words": "int64"})

    return texts.select("doc_id", "words").mapInPandas(score, schema)


def extremes(levelled: DataFrame) -> DataFrame:
    """``doc_id, grade`` of texts most of whose prose is at the first or the last grade."""
    return levelled.filter(F.col("level").isin(GRADES[0], GRADES[-1]) & (F.col("share") > 0.5)).select("doc_id", F.col("level").alias("grade"))
