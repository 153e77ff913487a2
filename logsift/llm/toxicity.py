"""Toxicity from a learned lexicon, misspellings by Levenshtein automata, and the context of every hit.

The lexicon is learned from labelled rows: whole words, and stems that many different words of toxic documents begin with. It is kept as
a trie. For a word of a text, the Levenshtein automaton of each term (one edit from ``FUZZY`` letters on; in shorter terms and in stems
if the labelled words one edit away are not those of clean documents) runs through the trie at once:
a state is the set of trie nodes with their edits so far, and states are made and remembered as texts need them. A misspelling counts as
an ordinary word if clean labelled documents use it plainly (not in quotation) and toxic ones not far more often.

Every hit is judged in a window of words: inside quotation marks or after a word of reporting it counts as quoted, else as plain. A
document's score is the share of toxic ones among labelled documents with as many plain hits, or with quoted hits only.

The fit reads at most about ``fit_rows`` labelled rows of either label, chosen by a hash of id and text. It keeps at most ``max_terms``
words, stems and ordinary words each, which bounds what is broadcast: those of most documents. What is beyond is no term, and an ordinary
word beyond counts as the misspelling that it looks like. Every row is scored over its whole text.

Defined results: null, empty and wordless texts score like texts without a hit. Without labels every score is 0. Rows with a null id are
scored but not learned from, and a label of a repeated row counts for each. An empty table stays empty; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import opened, shared_value, slices
from logsift.scratch import saved

FUZZY = 5  # shortest term that one edit may have changed without evidence
STEM = (4, 8)  # letters of a stem
STEM_WORDS = 5  # different words that make a stem
LONGEST = 40  # longer runs of letters do not become terms; they are matched like any other word
WINDOW = 8
KEPT_WORDS = 300_000
WORD = re.compile(r"[^\W\d_]+")
REPORTING = frozenset("said says wrote writes quote quoted called calls dit disait dijo dice sagte sagt schrieb".split())


@dataclass
class Node:
    children: dict[str, Node] = field(default_factory=dict)
    whole: int = -1  # edits of the term that ends here
    stem: int = -1  # edits of the stem that ends here, from which any word goes on
    name: str = ""
    edits: int = 0  # most edits that a term below may have


@dataclass(frozen=True)
class Lexicon:
    words: list[str]
    stems: list[str]
    edited: frozenset[str]  # words, and stems with an asterisk, that one edit may have changed
    spared: frozenset[str]  # words of clean documents one edit away from a term
    shares: dict[tuple[int, bool], float]  # score by plain hits (3: or more) and whether there are quoted ones


class Matcher:
    """Which words are terms, stems' continuations or misspelled terms. States are remembered as they come up."""

    def __init__(self, words: list[str], stems: list[str], spared: frozenset[str] = frozenset(), edited: frozenset[str] | None = None) -> None:
        self.root, self.spared = Node(), spared
        for term, is_stem in [(x, False) for x in words] + [(x, True) for x in stems]:
            usual = not is_stem and len(term) >= FUZZY
            node, edits = self.root, int(usual if edited is None else term + "*" * is_stem in edited)
            node.edits = max(node.edits, edits)
            for letter in term:
                node = node.children.setdefault(letter, Node())
                node.edits = max(node.edits, edits)
            node.name = term
            if is_stem:
                node.stem = edits
            else:
                node.whole = edits
        self.nodes = [self.root]
        self.number = {id(self.root): 0}
        self.steps: dict[tuple[frozenset, str], frozenset] = {}
        self.kept: dict[str, int] = {}
        self.first = self.closed({(0, 0)})

    def numbered(self, node: Node) -> int:
        if id(node) not in self.number:
            self.number[id(node)] = len(self.nodes)
            self.nodes.append(node)
        return self.number[id(node)]

    def closed(self, state: set[tuple[int, int]]) -> frozenset:
        """The state with what can be reached by leaving out letters of a term."""
        open_, seen = list(state), set(state)
        while open_:
            at, edits = open_.pop()
            for child in self.nodes[at].children.values():
                reached = (self.numbered(child), edits + 1)
                if edits < child.edits and reached not in seen:
                    seen.add(reached)
                    open_.append(reached)
        return frozenset(seen)

    def step(self, state: frozenset, letter: str) -> frozenset:
        key = (state, letter)
        if key not in self.steps:
            following: set[tuple[int, int]] = set()
            for at, edits in state:
                node = self.nodes[at]
                for named, child in node.children.items():
                    if named == letter:
                        following.add((self.numbered(child), edits))
                    elif edits < child.edits:
                        following.add((self.numbered(child), edits + 1))  # another letter
                if edits < node.edits:
                    following.add((at, edits + 1))  # a letter too many
            if len(self.steps) >= KEPT_WORDS:
                self.steps.clear()
            self.steps[key] = self.closed(following)
        return self.steps[key]

    def edits(self, word: str) -> int:
        """0 for a term or a stem's continuation, 1 for a misspelled term, -1 for any other word."""
        state, changed = self.first, False
        for letter in word:
            state = self.step(state, letter)
            if not state:
                break
            stems = [edits for at, edits in state if edits <= self.nodes[at].stem]
            if 0 in stems:
                return 0
            changed = changed or bool(stems)
        found = [edits for at, edits in state if edits <= self.nodes[at].whole]
        return min(found, default=1 if changed else -1)

    def changed(self, word: str) -> set[str]:
        """The terms, and stems with an asterisk, that one edit makes of the word or its beginning."""
        state, found = self.first, set()
        for letter in word:
            state = self.step(state, letter)
            found.update(self.nodes[at].name + "*" for at, edits in state if edits == 1 <= self.nodes[at].stem)
        return found.union(self.nodes[at].name for at, edits in state if edits == 1 <= self.nodes[at].whole)

    def hit(self, word: str) -> bool:
        found = self.kept.get(word)
        if found is None:
            edits = self.edits(word)
            found = int(edits == 0 or edits == 1 and word not in self.spared)
            if len(word) <= LONGEST:  # long runs seldom return, and would fill the memory
                if len(self.kept) >= KEPT_WORDS:
                    self.kept.clear()
                self.kept[word] = found
        return bool(found)


def spotted(text: str | None, matcher: Matcher) -> Iterator[tuple[str, bool]]:
    """Every hit of a text and whether it is quoted."""
    if not text:
        return
    lower = text.lower()
    found = {w for w in set(WORD.findall(lower)) if matcher.hit(w)}
    if not found:
        return
    spans = list(WORD.finditer(lower))
    for k, m in enumerate(spans):
        if m[0] in found:
            before = lower[spans[k - WINDOW - 1].end() if k > WINDOW else 0 : m.start()]
            after = lower[m.end() : spans[k + WINDOW + 1].start() if k + WINDOW + 1 < len(spans) else len(lower)]
            inside = before.count('"') % 2 == 1 and '"' in after or any(q in before for q in "“„«‹") and any(q in after for q in "”“»›")
            reported = not REPORTING.isdisjoint(w[0] for w in spans[max(0, k - WINDOW) : k])
            yield m[0], inside or reported


def hits(text: str | None, matcher: Matcher) -> tuple[int, int]:
    """Plain and quoted hits of a text."""
    found = [quoted for _, quoted in spotted(text, matcher)]
    return len(found) - sum(found), sum(found)


def learn(labelled: DataFrame, fit_rows: int = 10_000, max_terms: int = 5_000, least_docs: int = 3, given: dict[int, int] | None = None) -> Lexicon:
    """A lexicon of ``text, toxic``, which may be a sample of the ``given`` rows of either label. Words are counted by document and label;
    only terms far commoner in toxic documents are kept."""
    rows = labelled.where("text is not null and toxic in (0, 1)").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals.get(1):
        return Lexicon([], [], frozenset(), frozenset(), {})
    share = F.lit(0.0)
    for label, n in totals.items():
        share = F.when(F.col("toxic") == label, F.lit(min(1.0, fit_rows / n))).otherwise(share)
    chosen = saved(rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < share * 1_000_000), "labelled")
    totals = {x: (given or totals).get(x, n) for x, n in totals.items()}
    counts = {r["toxic"]: r["n"] for r in chosen.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = counts.get(1, 0), counts.get(0, 0)

    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col("text")), F.lit(r"[\p{L}]+"), 0))
    held = chosen.select("toxic", F.explode(words).alias("word")).where(F.length("word") <= LONGEST)
    by_word = saved(held.groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")), "word-counts")

    # A term is telling if its documents are toxic far more often than others, by a test that allows for the number of words tried.
    known = by_word.count()
    rate = bad / (bad + good) if good else 0.5
    b = "greatest(least(bad / (bad + good), 1 - 1e-9), 1e-9)"
    evidence = f"(bad + good) * ({b} * ln({b} / {rate!r}) + (1 - {b}) * ln((1 - {b}) / {1 - rate!r}))"
    telling = F.expr(f"bad >= {least_docs} and bad * {max(good, 1)} >= 9 * (good + 0.5) * {max(bad, 1)} and {evidence} >= {math.log(known + 1)!r}")
    begun = by_word.select("word", "bad", "good", F.explode(F.sequence(F.lit(STEM[0]), F.lit(STEM[1]))).alias("size")).where(F.length("word") > F.col("size"))
    stems = (
        begun.groupBy(F.expr("substring(word, 1, size)").alias("word"))
        .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count_if(F.col("bad") > 0).alias("words"))
        .where((F.col("words") >= STEM_WORDS) & telling)
    )
    order = [F.desc("bad"), "good", "word"]
    found = {r["word"]: r["bad"] for r in stems.orderBy(*order).limit(max_terms).collect()}
    # Of stems that begin with one another the longest that loses next to nothing, and none below a chosen one.
    roots: list[str] = []
    for stem in sorted(found, key=lambda x: (len(x), x)):
        if any(stem.startswith(x) for x in roots):
            continue
        roots.append(max((x for x in found if x.startswith(stem) and found[x] >= 0.95 * found[stem]), key=lambda x: (len(x), x)))
    terms = [r["word"] for r in by_word.where(telling).orderBy(*order).limit(max_terms).collect()]
    terms = sorted(terms)
    edited = _edited(by_word, terms, roots, bad, good)
    near = _plain_misspellings(chosen, Lexicon(terms, roots, edited, frozenset(), {}))
    ordinary = near.where((F.col("good") > 0) & (F.col("bad") * max(good, 1) < 3 * F.col("good") * max(bad, 1)))
    spared = frozenset(r["word"] for r in ordinary.orderBy(F.desc("good"), "word").limit(max_terms).collect())
    return Lexicon(terms, roots, edited, spared, _shares(chosen, Lexicon(terms, roots, edited, spared, {}), bad, good, totals))


def _edited(by_word: DataFrame, terms: list[str], stems: list[str], bad: int, good: int) -> frozenset[str]:
    """What one edit may have changed: terms from ``FUZZY`` letters on, and others if clean documents do not have words one edit away, or far seldomer."""
    short = [w for w in terms if len(w) < FUZZY]
    every = frozenset(short) | {x + "*" for x in stems}

    def near(batches: Iterator) -> Iterator:
        import pyarrow as pa

        matcher, exact = Matcher(short, stems, edited=every), Matcher(terms, stems, edited=frozenset())
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in ("word", "bad", "good")), strict=True)
            found = [(term, b, g) for word, b, g in rows if exact.edits(word) < 0 for term in matcher.changed(word)]
            columns = [pa.array([x[k] for x in found], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["term", "bad", "good"])

    counts = by_word.select("word", "bad", "good").mapInArrow(near, "term string, bad bigint, good bigint").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    clean = {r["term"] for r in counts.where((F.col("good") > 0) & (F.col("bad") * max(good, 1) < 9 * F.col("good") * max(bad, 1))).collect()}
    return frozenset(w for w in terms if len(w) >= FUZZY) | (every - clean)


def _plain_misspellings(chosen: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``word, bad, good``: documents of either label that use a word one edit away from a term, quotations left out."""
    shared = shared_value(chosen.sparkSession, lexicon)

    def near(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known = opened(shared)
        matcher = Matcher(known.words, known.stems, edited=known.edited)
        for batch in slices(batches, 512):
            rows = zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True)
            found = [(w, toxic) for toxic, text in rows for w in {w for w, quoted in spotted(text, matcher) if not quoted and matcher.edits(w) == 1}]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([t for _, t in found], pa.int64())], ["word", "toxic"])

    uses = chosen.select("toxic", "text").mapInArrow(near, "word string, toxic bigint")
    return uses.groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))


def _shares(chosen: DataFrame, lexicon: Lexicon, bad: int, good: int, totals: dict[int, int]) -> dict[tuple[int, bool], float]:
    """Share of toxic documents by hits, weighted back to the labels as they were given. Quoted hits alone never outweigh a plain one."""
    kinds = F.struct(F.least("plain", F.lit(3)).alias("plain"), (F.col("quoted") > 0).alias("quoted"))
    found = count_hits(chosen.select(F.col("toxic").alias("doc_id"), "text"), lexicon)
    rows = found.groupBy(F.col("doc_id").alias("toxic"), kinds.alias("kind")).agg(F.count(F.lit(1)).alias("n")).collect()
    weight = {1: totals[1] / max(bad, 1), 0: totals.get(0, 0) / max(good, 1)}
    shares: dict[tuple[int, bool], float] = {}
    for plain in range(4):
        for quoted in (False, True):
            of = {label: sum(r["n"] for r in rows if r["toxic"] == label and r["kind"]["plain"] == plain and r["kind"]["quoted"] == quoted) * weight[label] for label in (0, 1)}
            prior = 0.02 if plain == 0 and not quoted else 0.25 if plain == 0 else 0.75
            shares[plain, quoted] = (of[1] + prior) / (of[0] + of[1] + 1)
    return shares


def count_hits(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``doc_id, plain, quoted``: hits of every row of ``doc_id, text``."""
    shared = shared_value(docs.sparkSession, lexicon)

    def counted(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known = opened(shared)
        matcher = Matcher(known.words, known.stems, known.spared, known.edited)
        for batch in slices(batches, 512):
            found = [hits(x, matcher) for x in batch.column("text").to_pylist()]
            plain, quoted = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(plain, pa.int64()), pa.array(quoted, pa.int64())], ["doc_id", "plain", "quoted"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(counted, "doc_id bigint, plain bigint, quoted bigint")


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``doc_id, score, plain, quoted`` of every row of ``doc_id, text``, from the text alone."""
    found = count_hits(docs, lexicon)
    result = F.lit(0.0)
    for (plain, quoted), share in lexicon.shares.items():
        result = F.when((F.least("plain", F.lit(3)) == plain) & ((F.col("quoted") > 0) == quoted), F.lit(float(share))).otherwise(result)
    return found.select("doc_id", result.alias("score"), "plain", "quoted")
