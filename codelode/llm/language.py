"""Languages of documents and of stretches inside them, by cross-parsing."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.session import spread_out

#: Bounds of the training text: labelled documents per language, characters of each, and characters per language.
SAMPLE_DOCS, SAMPLE_CHARS = 200, 20_000
#: Ids are first drawn by a threshold on their hash, this many times as many as are wanted.
DRAW = 8
#: Texts of about so many characters are judged together.
BATCH_CHARS = 1 << 20
#: Below this margin between the best and the second language a sentence goes by its neighbours.
SURE = 0.2
#: Sentences of fewer words need a margin that is larger by SHORT for each word they lack.
LEAST_WORDS, SHORT = 4, 0.1
#: In a document without any certain sentence the sum over its whole sentences decides, from this margin on.
TOGETHER = 0.1

# Codes and English names by which labels name a language. Languages of the
# samples that are not listed go by the code that the samples use.
NAMES = {
    "bg": "bg bul bulgarian",
    "ca": "ca cat catalan",
    "cs": "cs ces cze czech",
    "da": "da dan danish",
    "de": "de deu ger german",
    "el": "el ell gre greek",
    "en": "en eng english",
    "es": "es spa spanish castilian",
    "et": "et est estonian",
    "fi": "fi fin finnish",
    "fr": "fr fra fre french",
    "hr": "hr hrv croatian",
    "hu": "hu hun hungarian",
    "id": "id ind indonesian",
    "it": "it ita italian",
    "ja": "ja jpn japanese",
    "ko": "ko kor korean",
    "lt": "lt lit lithuanian",
    "lv": "lv lav latvian",
    "nl": "nl nld dut dutch flemish",
    "pl": "pl pol polish",
    "pt": "pt por portuguese",
    "ro": "ro ron rum romanian",
    "ru": "ru rus russian",
    "sk": "sk slk slo slovak",
    "sl": "sl slv slovenian slovene",
    "sv": "sv swe swedish",
    "tr": "tr tur turkish",
    "uk": "uk ukr ukrainian",
    "vi": "vi vie vietnamese",
    "zh": "zh zho chi chinese",
}

FENCE = regex.compile(r"^\s*(?:>\s*)*(?:```|~~~)")
MARK = regex.compile(r"^\s*(?:(?P<quote>(?:>\s?)+)\s*)?(?P<mark>///?!?|//!|--+|#+!?|/\*+|\*+/|\*+|;+|%+|<!--|\"\"\"|''')?\s*(?:(?:[-+•]|\d{1,3}[.)])\s+)?")
CLOSE = regex.compile(r"\s*(?:\*+/|-->|\"\"\"|''')\s*$")
TRAILING = regex.compile(r"^[^\p{L}]*[{}();,\]]+\s*(?:///?|#+|--+)\s+(?=\p{L}|[¿¡«“\"'`(])|^.*[{};]\s*(?:///?|#+|--+)\s+(?=\p{L}|[¿¡«“\"'`(])")
CODE = regex.compile(
    r"^\s*(?:[@#]\w+\b.*|(?:const|let|var|func|fn|def|class|struct|enum|interface|public|private|protected|static|import|from|package|use|return|if|elif|else|for|while|switch|case|try|catch|except|with|yield|await|async|raise|throw|pub|impl|type|namespace|using|include|template|void|int|bool|string)\b.*(?:[{}();=:\[\]]|->).*"
    r"|.*[{};]\s*|[^.!?]*(?:->|=>|:=|==|\+=|-=|&&|\|\||::).*|[\w.\[\]]+\s*(?:\(.*\)|=\s*\S.*)\s*;?|return\s+\S+|[\p{P}\p{S}\d\s]*)$"
)
END = regex.compile(r"(?<=[.!?…。！？][\"'”’»)\]]{0,2})\s+(?=\S)")
ENDS = regex.compile(r"[.!?…。！？][\"'”’»)\]*_]{0,3}$")
# What is no language: code in backticks, addresses, words in two parts, and words with digits, inner capitals, underscores, dots or slashes.
QUOTED = regex.compile(r"`[^`]*`|\b\w+://\S+")
ALIEN = regex.compile(r"[\d_/\\@#$%^&*+=<>{}|~]|\p{Ll}\p{Lu}|\w\.\w|\w\(\)")
PAIRED = regex.compile(r"\b\p{ASCII}[a-z]{3,}-[a-z]{4,}\b")
WORD = regex.compile(r"\p{L}[\p{L}\p{M}'’]*")


def named_language(label: Column, names: dict[str, str] = NAMES) -> Column:
    """The language that a label names, by code or English name, in any case, with or without region; else null."""
    plain = F.lower(F.regexp_replace(label, r"(?U)^\s+|\s+$", ""))
    head = F.element_at(F.split(plain, r"[-_. (]"), 1)
    table = {word: code for code, words in names.items() for word in words.split()}
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[head]


def known_names(samples: DataFrame) -> dict[str, str]:
    """NAMES, and the languages of the samples that it lacks under their own code."""
    codes = [r[0] for r in samples.select("lang").dropna().distinct().collect()]
    return NAMES | {c: c.strip().lower() for c in sorted(codes) if c.strip() and c not in NAMES}


def plain(sentence: str) -> str:
    """Only the words of a language, in lower case, single spaces, a space at both ends."""
    if "`" in sentence or "://" in sentence:
        sentence = QUOTED.sub(" ", sentence)
    if ALIEN.search(sentence):
        sentence = " ".join([w for w in sentence.split() if not ALIEN.search(w)])
    if "-" in sentence:
        sentence = PAIRED.sub(" ", sentence)
    return f" {' '.join(WORD.findall(sentence))} ".lower()


def prose(text: str) -> list[tuple[int, int, int, str, bool]]:
    """(paragraph, start, end, words, whole) of the sentences in a text's prose.

    Fenced and indented blocks, lines of code and headings are left out, marks of quotes
    and comments ignored. A sentence is whole if it ends as one.
    """
    out: list[tuple[int, int, int, str, bool]] = []
    block: list[tuple[int, str]] = []
    kind: object = None
    para, fenced, at = 0, False, 0

    def flush() -> None:
        nonlocal block, para
        if not block:
            return
        joined, spans = "", []
        for start, line in block:
            spans.append((len(joined), start))
            joined += line + " "
        joined = joined.rstrip()
        begin = 0
        for cut in [m.span() for m in END.finditer(joined)] + [(len(joined), len(joined))]:
            part = joined[begin : cut[0]]
            words = plain(part)
            if words.strip():
                i = max(k for k, (off, _) in enumerate(spans) if off <= begin)
                j = max(k for k, (off, _) in enumerate(spans) if off <= max(begin, cut[0] - 1))
                out.append((para, spans[i][1] + begin - spans[i][0], spans[j][1] + cut[0] - spans[j][0], words, bool(ENDS.search(part.rstrip()))))
            begin = cut[1]
        block = []
        para += 1

    lines = text.split("\n")
    for n, raw in enumerate(lines):
        start, at = at, at + len(raw) + 1
        line = raw.rstrip("\r")
        if FENCE.match(line):
            fenced = not fenced
            flush()
            continue
        if fenced:
            continue
        tail = TRAILING.match(line)
        m = MARK.match(line)
        # A quote opened by mark characters alone is no mark: "* " and "# " have a space, "//" need none.
        body = line[tail.end() :] if tail else line[m.end() :]
        offset = start + (tail.end() if tail else m.end())
        mark = "tail" if tail else (m["quote"] or "").strip()[:1] + (m["mark"] or "")[:2]
        body = CLOSE.sub("", body).rstrip()
        if not body.strip():
            flush()
            kind = None
            continue
        if mark.endswith("#") and not tail and not ENDS.search(body):
            follows = MARK.match(lines[n + 1])["mark"] if n + 1 < len(lines) else None
            if not (follows or "").startswith("#") and not (block and kind == mark):
                flush()  # a heading
                kind = None
                continue
        if not mark and (line.startswith(("    ", "\t")) or CODE.match(body)) or (mark and CODE.match(body) and not ENDS.search(body)):
            flush()
            kind = None
            continue
        if mark != kind or tail:
            flush()
            kind = mark
        block.append((offset, body))
        if tail:
            flush()
    flush()
    return out


class Automaton:
    """Suffix automaton of one text: follows any of its substrings, one character at a time."""

    def __init__(self, text: str) -> None:
        self.next: list[dict[str, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            new = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    copy = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    link[q] = link[new] = copy
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = copy
                        p = link[p]
            last = new
        self.bits = math.log2(len(text) + 2)

    def cost(self, text: str) -> float:
        """Bits per character when text is parsed greedily into the longest substrings of this text."""
        after, state, phrases = self.next, -1, 0
        for c in text:
            step = after[state].get(c) if state >= 0 else None
            if step is None:
                phrases += 1
                step = after[0].get(c, -1)  # a character that never occurs is a phrase of its own
            state = step
        return phrases * self.bits / len(text)


class Model:
    """One automaton per language, laid out as one table, so that many sentences are parsed a character at a time together."""

    def __init__(self, texts: dict[str, str]) -> None:
        self.languages = sorted(texts)
        automata = [Automaton(texts[k]) for k in self.languages]
        self.bits = np.array([a.bits for a in automata])
        self.codes = {c: i + 1 for i, c in enumerate(sorted(set().union(*map(set, texts.values()))))}
        # Each language numbers its own letters, so that the table has few columns; 0 is a letter that it lacks.
        local = [{c: i + 1 for i, c in enumerate(sorted(set(texts[k])))} for k in self.languages]
        self.width = 1 + max(map(len, local), default=0)
        self.local = np.zeros((len(automata), len(self.codes) + 1), np.int32)
        sizes = [len(a.next) + 1 for a in automata]
        first = np.cumsum([0, *sizes])[:-1]
        self.table = np.full(sum(sizes) * self.width, -1, np.int32)
        for k, a in enumerate(automata):
            for c, i in local[k].items():
                self.local[k, self.codes[c]] = i
            for state, after in enumerate(a.next):
                for c, to in after.items():
                    self.table[(first[k] + state) * self.width + local[k][c]] = first[k] + to
        # The last state of each language is that of a letter it lacks, from which nothing goes on.
        self.lost = (first + np.array(sizes, int) - 1).astype(np.int32) if automata else np.empty(0, np.int32)
        self.roots = first.astype(np.int32)
        self.known: dict[str, tuple[str, float]] = {}

    def costs(self, sentences: list[str]) -> np.ndarray:
        """Bits per character (languages x sentences)."""
        sizes = np.array([len(w) for w in sentences])
        order = np.argsort(-sizes, kind="stable")
        starts = (np.cumsum(sizes) - sizes)[order]
        text = np.array([self.codes.get(c, 0) for w in sentences for c in w], np.int32)
        phrases = np.zeros((len(self.languages), len(sentences)), np.int32)
        state = np.repeat(self.lost[:, None], len(sentences), axis=1)
        longest_first = sizes[order]
        for t in range(longest_first[0] if len(sentences) else 0):
            n = int(np.searchsorted(-longest_first, -t, "left"))
            letter = self.local[:, text[starts[:n] + t]]
            step = self.table[state[:, :n] * self.width + letter]
            fresh = step < 0
            phrases[:, :n] += fresh
            again = self.table[self.roots[:, None] * self.width + letter]
            state[:, :n] = np.where(fresh, np.where(again < 0, self.lost[:, None], again), step)
        out = np.empty(phrases.shape)
        out[:, order] = phrases * self.bits[:, None] / longest_first[None, :]
        return out

    def judge_all(self, sentences: list[str]) -> list[tuple[str, float]]:
        """(language, margin) of each: the language that needs the fewest normalised phrases, and by what share fewer than the next."""
        if len(self.known) >= 100_000:
            self.known.clear()
        new = list({w for w in sentences if w not in self.known})
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            costs = self.costs(part)
            best = np.argmin(costs, axis=0)
            low = np.sort(costs, axis=0)
            margin = 1 - low[0] / low[1] if len(costs) > 1 else np.ones(len(part))
            self.known.update((w, (self.languages[b], float(m))) for w, b, m in zip(part, best, margin))
        return [self.known[w] for w in sentences]

    def together(self, sentences: list[str]) -> tuple[str, float]:
        """The same for the sum over several sentences."""
        sums = self.costs(sentences) @ np.array([len(w) for w in sentences])
        order = np.argsort(sums, kind="stable")
        return self.languages[order[0]], 1 - sums[order[0]] / sums[order[1]] if len(sums) > 1 else 1.0


def certain(words: str, margin: float) -> bool:
    """Whether a sentence tells its language by itself; the shorter it is, the more clearly it must."""
    return margin >= SURE + SHORT * max(0, LEAST_WORDS - (words.count(" ") - 1))


def training_texts(samples: list[tuple[str, str]], labelled: list[tuple[int, str, str]]) -> dict[str, str]:
    """Text per language: the samples, and those sentences of labelled documents that are in the language of their label.

    Labels may be wrong, and documents mixed. So a sentence is taken only for the label that
    it bears most often, only from documents of which a model that has not seen them says
    mostly the same as the label, and not if that model is sure of another language for
    the sentence. The first such model is that of the samples, then each half of the
    documents is judged by the model of the other half.
    """
    base: dict[str, list[str]] = defaultdict(list)
    for lang, text in sorted(samples):
        if lang and text:
            base[lang].append(plain(text))
    heard = [(doc_id, lang, words) for doc_id, lang, text in sorted(labelled) for _, _, _, words, whole in prose(text) if whole and words.count(" ") > LEAST_WORDS and lang in base]
    votes: dict[str, Counter[str]] = defaultdict(Counter)
    for _, lang, words in heard:
        votes[words][lang] += 1

    def joined(extra: list[tuple[int, str, str]]) -> dict[str, str]:
        texts = {k: "".join(v) for k, v in base.items()}
        seen: set[tuple[str, str]] = set()
        for _, lang, words in extra:
            if (lang, words) not in seen and len(texts[lang]) + len(words) <= SAMPLE_CHARS:
                seen.add((lang, words))
                texts[lang] += words
        return texts

    def agreed(models: list[Model], tolerance: float) -> list[tuple[int, str, str]]:
        said_by = [m.judge_all([words for _, _, words in heard]) for m in models]
        judged = [(doc_id, lang, words, *said_by[doc_id % len(models)][i]) for i, (doc_id, lang, words) in enumerate(heard)]
        said: dict[int, Counter[str]] = defaultdict(Counter)
        for doc_id, _, words, got, _ in judged:
            said[doc_id][got] += len(words)
        return [
            (doc_id, lang, words)
            for doc_id, lang, words, got, margin in judged
            if said[doc_id].most_common(1)[0][0] == lang and votes[words].most_common(1)[0][0] == lang and (got == lang or margin < tolerance)
        ]

    if len(base) < 2:
        return joined([])
    kept = agreed([Model(joined([]))], 0.35)
    # Model k is of the documents with the other parity, so that none is judged by its own sentences.
    halves = [Model(joined([x for x in kept if x[0] % 2 != k])) for k in (0, 1)]
    return joined(agreed(halves, SURE))


def segments_of(read: list[tuple[int, int, int, str, bool]], told: list[tuple[str, float]], model: Model) -> list[tuple[int, int, str, float, int, int]]:
    """(start, end, language, confidence, sentences, sure): the stretches of one language in a text, in order, from its prose and what each sentence was judged.

    ``sure`` counts the whole sentences whose language was decided by themselves, or, where
    no sentence of the text is certain, by all of them together.
    """
    found = [(*sentence, *judged) for sentence, judged in zip(read, told)]
    weight: Counter[str] = Counter()
    near: dict[int, Counter[str]] = defaultdict(Counter)
    sure = [certain(words, margin) for _, _, _, words, _, _, margin in found]
    if not any(ok and whole for ok, (_, _, _, _, whole, _, _) in zip(sure, found)):
        # No whole sentence tells its language by itself, but all of them together may.
        whole_ones = [words for _, _, _, words, whole, _, _ in found if whole]
        lang, margin = model.together(whole_ones) if whole_ones else ("", 0.0)
        if margin >= TOGETHER and sum(w.count(" ") - 1 for w in whole_ones) >= LEAST_WORDS:
            sure = [whole for _, _, _, _, whole, _, _ in found]
            found = [(p, a, b, words, whole, lang, margin) if whole else (p, a, b, words, whole, own, m) for p, a, b, words, whole, own, m in found]
    for (p, _, _, words, _, lang, margin), ok in zip(found, sure):
        if ok:
            weight[lang] += len(words)
            near[p][lang] += len(words)
    out: list[list] = []
    for (p, a, b, words, whole, lang, margin), ok in zip(found, sure):
        if not ok:
            around = near[p] or weight
            lang = around.most_common(1)[0][0] if around else lang
        if out and out[-1][2] == lang:
            last = out[-1]
            last[1], last[3], last[4], last[5], last[6] = b, last[3] + margin * len(words), last[4] + 1, last[5] + (ok and whole), last[6] + len(words)
        else:
            out.append([a, b, lang, margin * len(words), 1, int(ok and whole), len(words)])
    return [(a, b, lang, round(total / size, 6), n, sure) for a, b, lang, total, n, sure, size in out]


_models: dict[tuple, Model] = {}


def fitted(documents: DataFrame, samples: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "lang") -> dict[str, str]:
    """The training texts, from the samples and a bounded sample of labelled documents.

    Of each language those SAMPLE_DOCS documents count whose ids hash lowest. Ids are drawn
    before any text is read: per language a threshold on the hash leaves DRAW times as many
    as are wanted, of which the lowest are taken; only their texts are fetched, the first
    SAMPLE_CHARS characters of each. Of the samples those count that hash lowest, too, as many as
    fill SAMPLE_CHARS characters of a language. This is the classifier's whole training
    text, and all that reaches the driver.
    """
    names = known_names(samples)
    drawn = documents.select(F.col(doc_id).cast("long").alias("_doc"), named_language(F.col(label), names).alias("_lang"), F.xxhash64(doc_id).alias("_draw"), F.col(text).isNotNull().alias("_told"))
    drawn = drawn.where("_told").drop("_told").dropna()
    sizes = drawn.groupBy("_lang").agg(F.count(F.lit(1)).alias("_n"))
    # The hash runs over all 64-bit integers; its share below the threshold is DRAW * SAMPLE_DOCS / n.
    share = F.least(F.lit(1.0), F.lit(float(DRAW * SAMPLE_DOCS)) / F.col("_n"))
    few = drawn.join(F.broadcast(sizes), "_lang").where(F.shiftright("_draw", 1) / F.lit(2.0**63) + 0.5 <= share)
    place = F.row_number().over(Window.partitionBy("_lang").orderBy("_draw", "_doc"))
    ids = few.select("_lang", "_doc", "_draw").distinct().withColumn("_at", place).where(F.col("_at") <= SAMPLE_DOCS).select("_doc", "_lang")
    texts = documents.select(F.col(doc_id).cast("long").alias("_doc"), F.substring(text, 1, SAMPLE_CHARS).alias("_text")).dropna()
    labelled = [tuple(r) for r in texts.join(F.broadcast(ids), "_doc").select("_doc", "_lang", "_text").distinct().collect()]
    long = F.sum(F.length("text") + 1).over(Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text").rowsBetween(Window.unboundedPreceding, -1))
    shown = samples.select("lang", F.substring("text", 1, SAMPLE_CHARS).alias("text")).dropna().distinct().withColumn("_before", F.coalesce(long, F.lit(0)))
    return training_texts([tuple(r) for r in shown.where(F.col("_before") < SAMPLE_CHARS).select("lang", "text").collect()], labelled)


def language_segments(documents: DataFrame, samples: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """(doc_id, segment, start, end, lang, confidence, n_sentences, n_sure) of each stretch of prose in one language.

    Whole texts are read, at most one row per change of language comes out. A document
    without prose, a null or empty text, or a null id gives no rows. Documents delivered
    twice give equal rows, which count once. Where no samples are given there is no
    language to find and no rows come out. Extra columns are not read.
    """
    texts = fitted(documents, samples, doc_id, text, label)
    shared = documents.sparkSession.sparkContext.broadcast(texts)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = tuple(sorted(shared.value.items()))
        if key not in _models:
            _models.clear()
            _models[key] = Model(shared.value)
        model = _models[key]
        for batch in batches:
            out = []
            group = (batch["_text"].str.len().cumsum() // BATCH_CHARS).to_numpy()
            for g in np.unique(group):
                part = batch[group == g]
                read = [prose(t) for t in part["_text"]]
                # Sentences of many texts are judged together.
                told = iter(model.judge_all([w for r in read for _, _, _, w, _ in r]))
                out += [(d, i, *s) for d, r in zip(part["_doc"], read) for i, s in enumerate(segments_of(r, [next(told) for _ in r], model))]
            yield pd.DataFrame(out, columns=["doc_id", "segment", "start", "end", "lang", "confidence", "n_sentences", "n_sure"])

    schema = "doc_id long, segment int, start long, end long, lang string, confidence double, n_sentences int, n_sure int"
    rows = documents.select(F.col(doc_id).cast("long").alias("_doc"), F.col(text).alias("_text")).dropna()
    if not texts:
        return documents.sparkSession.createDataFrame([], schema)
    return spread_out(rows, "_doc").mapInPandas(find, schema).distinct()


def document_languages(segments: DataFrame, documents: DataFrame, doc_id: str = "doc_id", label: str = "lang", names: dict[str, str] = NAMES) -> DataFrame:
    """(doc_id, lang, confidence, labelled): the language of most of a document's prose, null without prose, and the one its label names.

    confidence is the mean confidence of that language's stretches times its share of the prose.
    """
    size = F.col("end") - F.col("start")
    per = segments.groupBy("doc_id", "lang").agg(F.sum(size).alias("size"), (F.sum(F.col("confidence") * size) / F.sum(size)).alias("mean"))
    best = per.groupBy("doc_id").agg(F.max(F.struct("size", "lang", "mean")).alias("b"), F.sum("size").alias("all"))
    ids = documents.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(F.min(named_language(F.col(label), names)).alias("labelled"))
    return ids.join(best, "doc_id", "left").select("doc_id", F.col("b.lang").alias("lang"), F.coalesce(F.col("b.mean") * F.col("b.size") / F.col("all"), F.lit(0.0)).alias("confidence"), "labelled")


def unlabelled_languages(segments: DataFrame, documents: DataFrame, doc_id: str = "doc_id", label: str = "lang", names: dict[str, str] = NAMES) -> DataFrame:
    """(doc_id, lang): languages with a whole sentence in a document whose label does not name them."""
    labels = documents.select(F.col(doc_id).cast("long").alias("doc_id"), named_language(F.col(label), names).alias("_named")).where(F.col("doc_id").isNotNull() & F.col("_named").isNotNull()).distinct()
    held = segments.where(F.col("n_sure") > 0).select("doc_id", "lang").distinct()
    return held.join(labels, (held["doc_id"] == labels["doc_id"]) & (held["lang"] == labels["_named"]), "left_anti")
