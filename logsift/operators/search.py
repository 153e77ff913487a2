"""Full-text search over the recall table: a term table, and substring search when it has no hit."""

from __future__ import annotations

import re
import string
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift.functions.text import fn, let, lit
from logsift.scratch import saved


def _accents() -> tuple[str, str]:
    """Letters with an accent and their plain letters, from the Unicode decompositions."""
    marked, plain = [], []
    for point in range(0xC0, 0x250):
        base = unicodedata.normalize("NFD", chr(point))
        if len(base) > 1 and all(unicodedata.combining(c) for c in base[1:]):
            marked.append(chr(point))
            plain.append(base[0])
    return "".join(marked), "".join(plain)


_MARKED, _PLAIN = _accents()
BUCKETS = 64


def folded(text: str) -> str:
    """Lower case without accents."""
    return f"translate(lower({text}), {lit(_MARKED)}, {lit(_PLAIN)})"


def terms(text: str) -> str:
    """Words of a text, letters and digits only."""
    return f"filter(split({folded(text)}, {lit(r'[^\p{L}\p{N}]+')}), {fn(lambda t: f"{t} != ''")})"


FIELDS = ("command", "raw")
_QUERY = re.compile(r'"(?:[^"]|"")*"|[()*:]|\w+|\S')


class NotAQuery(ValueError):
    """The text is no word query; it is looked for as it stands."""


@dataclass(frozen=True)
class Phrase:
    """Words that follow one another in one field; of the last one only the beginning may be given."""

    words: tuple[str, ...]
    begins: bool = False
    field: str | None = None


def words_of(text: str) -> tuple[str, ...]:
    """The words of a piece of a query, as the index has them."""
    return tuple(re.findall(r"[^\W_]+", text.lower().translate(str.maketrans(_MARKED, _PLAIN))))


def parsed_query(query: str) -> Any:
    """A ``Phrase``, or ``(operator, left, right)``; None if nothing is asked for. Raises ``NotAQuery``.

    Words and ``"phrases"``, ``begin*``, ``field:word``; side by side they all have to occur. ``NOT``, ``AND`` and ``OR`` in capitals
    combine what stands around them, ``NOT`` first and ``OR`` last, and parentheses group.
    """
    left = _QUERY.findall(query)

    def take(*wanted: str) -> bool:
        if left and left[0] in wanted:
            left.pop(0)
            return True
        return False

    def phrase() -> Phrase:
        if not left or not (left[0].startswith('"') and len(left[0]) > 1 or re.fullmatch(r"\w+", left[0])) or left[0] in ("AND", "OR", "NOT"):
            raise NotAQuery(query)
        text = left.pop(0)
        if take(":"):
            if text.lower() not in FIELDS:
                raise NotAQuery(query)
            found = phrase()
            return replace(found, field=found.field or text.lower())
        words = words_of(text[1:-1].replace('""', '"') if text.startswith('"') else text)
        return Phrase(words, take("*"))

    def beside() -> Any:
        if take("("):
            found = operators(("OR", "AND", "NOT"))
            if not take(")"):
                raise NotAQuery(query)
            return found
        found = combined("AND", None, phrase())
        while left and left[0] not in ("AND", "OR", "NOT", ")"):
            found = combined("AND", found, phrase())
        return found

    def combined(operator: str, one: Any, other: Any) -> Any:
        if isinstance(other, Phrase) and not other.words:
            other = None  # a phrase of no word asks for nothing
        if one is None or other is None:
            return other if one is None and operator != "NOT" else one
        return operator, one, other

    def operators(names: tuple[str, ...]) -> Any:
        if not names:
            return beside()
        found = operators(names[1:])
        while take(names[0]):
            found = combined(names[0], found, operators(names[1:]))
        return found

    found = operators(("OR", "AND", "NOT"))
    if left:
        raise NotAQuery(query)
    return found


def phrases_of(tree: Any) -> list[Phrase]:
    if tree is None or isinstance(tree, Phrase):
        return [tree] if tree else []
    return list(dict.fromkeys(p for part in tree[1:] for p in phrases_of(part)))


def postings(store: DataFrame) -> DataFrame:
    """``term, id, field, tf, positions, ts``: where each word occurs in each field of each row. No shuffle.

    Spark cuts the words. Those of some rows at a time are numbered, sorted by row and number, and cut into runs as whole arrays, in Arrow:
    sorting words and places inside a row is interpreted word by word. Nothing is kept between batches.
    """
    # NULL from inside a lambda, as a column that Spark takes to have none may hold one; out of a generator, so that the fields are made below it.
    cut = ", ".join(f"'words_{field}', {let(field, lambda t: terms(f"nullif({t}, '')"))}" for field in FIELDS)
    words = store.select("id", "ts", F.explode(F.array(F.expr(f"named_struct({cut})"))).alias("w")).select("id", "ts", "w.*")
    id_kind, ts_kind = words.schema["id"], words.schema["ts"]
    whole = T.IntegerType()
    plain = [("term", T.StringType()), ("id", id_kind.dataType), ("field", T.StringType()), ("tf", whole), ("positions", T.ArrayType(whole)), ("ts", ts_kind.dataType)]
    fields, names, at_once = FIELDS, [n for n, _ in plain], 1024

    def runs(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                rows = batch.slice(at, at_once)
                for k, field in enumerate(fields):
                    lists = rows.column(2 + k)
                    flat = lists.flatten().dictionary_encode()
                    if not len(flat):
                        continue
                    sizes = lists.value_lengths().fill_null(0).to_numpy()
                    row = np.repeat(np.arange(len(lists)), sizes)
                    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                    key = row * len(flat.dictionary) + flat.indices.to_numpy()
                    order = np.argsort(key, kind="stable")
                    starts = np.flatnonzero(np.diff(key[order], prepend=-1))
                    edges = np.append(starts, len(flat)).astype(np.int32)
                    positions = pa.ListArray.from_arrays(pa.array(edges), pa.array(place[order].astype(np.int32)))
                    of_run = order[starts]
                    told = [flat.dictionary.take(flat.indices.take(pa.array(of_run))), pa.repeat(field, len(starts)), pa.array(np.diff(edges)), positions]
                    own = [rows.column(c).take(pa.array(row[of_run])) for c in (0, 1)]
                    yield pa.RecordBatch.from_arrays([told[0], own[0], *told[1:], own[1]], names)

    return words.mapInArrow(runs, T.StructType([T.StructField(*x) for x in plain]))


def write_postings(index: DataFrame, path: str) -> None:
    """Partition by term bucket, each in the order of its terms. Rebalancing splits a bucket that is large, so a common word is no hot task.

    Positions ascend within a row, and the second version of the format stores whole numbers as differences.
    """
    bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).alias("bucket")
    laid_out = index.select("*", bucket).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "id")
    laid_out.write.partitionBy("bucket").mode("overwrite").option("parquet.writer.version", "PARQUET_2_0").parquet(path)


def _lookup(index: DataFrame, phrases: list[Phrase]) -> DataFrame:
    """Postings of the phrases' words. Buckets of whole words are pruned; beginnings are met in the statistics of sorted files."""
    whole = sorted({w for p in phrases for w in (p.words[:-1] if p.begins else p.words)})
    begun = sorted({p.words[-1] for p in phrases if p.begins})
    hit = F.col("term").isin(whole)
    for start in begun:
        hit = hit | F.startswith("term", F.lit(start))
    found = index.filter(hit)
    if "bucket" in index.columns and not begun:
        # Same hash as the layout, worked out by Spark on the literals: prunes directories.
        buckets = index.sparkSession.range(1).select(F.array(*[F.pmod(F.xxhash64(F.lit(t)), F.lit(BUCKETS)) for t in whole]).alias("b"))
        found = found.filter(F.col("bucket").isin(buckets.first().b))
    return found


def moved_back(by: int) -> Callable[[Column], Column]:
    return lambda x: x - by


def matching(index: DataFrame, query: str) -> DataFrame:
    """``id, ts`` of rows that a query matches. Only the postings of its words are read and shuffled, by row.

    A phrase occurs where the places of its words, each moved back by its distance from the first, have one in common.
    """
    tree = parsed_query(query)
    phrases = phrases_of(tree)
    if not phrases:
        return index.select("id", "ts").limit(0)
    columns: dict[tuple, str] = {}

    def places(field: str, word: str, begins: bool) -> str:
        return columns.setdefault((field, word, begins), f"_p{len(columns)}")

    def occurs(p: Phrase) -> Column:
        either = F.lit(False)
        for field in (p.field,) if p.field else FIELDS:
            common = None
            for k, word in enumerate(p.words):
                at = F.col(places(field, word, p.begins and k == len(p.words) - 1))
                moved = F.transform(at, moved_back(k)) if k else at
                common = moved if common is None else F.array_intersect(common, moved)
            either = either | (F.size(common) > 0)
        return either

    def judged(node: Any) -> Column:
        if isinstance(node, Phrase):
            return occurs(node)
        operator, one, other = node
        one, other = judged(one), judged(other)
        return {"AND": one & other, "OR": one | other, "NOT": one & ~other}[operator]

    wanted = judged(tree)
    found = []
    for (field, word, begins), name in columns.items():
        term = F.startswith("term", F.lit(word)) if begins else F.col("term") == word
        found.append(F.flatten(F.collect_list(F.when((F.col("field") == field) & term, F.col("positions")))).alias(name))
    rows = _lookup(index, phrases).groupBy("id").agg(F.max("ts").alias("ts"), *found)
    return rows.filter(wanted).select("id", "ts")


def newest_hits(index: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Ids of the newest rows that a query matches, at most ``limit``."""
    return matching(index, query).orderBy(F.desc("ts"), "id").limit(limit).select("id")


def search_terms(store: DataFrame, index: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Newest rows that a word query matches. Only ``limit`` ids are broadcast."""
    return store.join(F.broadcast(newest_hits(index, query, limit)), "id").orderBy(F.desc("ts"), "id")


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def search_like(store: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Newest rows whose command or text contains the query. ASCII case is ignored; % and _ match anything."""
    found = None
    for field in ("command", "raw"):
        hit = _ascii_lower(F.col(field)).like(query_pattern(query))
        found = hit if found is None else found | hit
    return store.filter(found).orderBy(F.desc("ts"), "id").limit(limit)


SIGNATURE_BITS = 1 << 16


def signatures_path(path: str) -> str:
    return f"{path.rstrip('/')}-trigrams"


def _trigram_places() -> Callable[[str], Any]:
    """A function that gives the place of every trigram of a text, A-Z lower-cased, in a signature. It travels without this package."""
    import numpy as np

    odd, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - (SIGNATURE_BITS.bit_length() - 1))

    def places(text: str) -> Any:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        points[(points >= 65) & (points <= 90)] += np.uint64(32)
        # Three code points of 21 bits are one number, and the highest bits of its product the place.
        return (((points[:-2] << np.uint64(42)) | (points[1:-1] << np.uint64(21)) | points[2:]) * odd) >> shift

    return places


def write_signatures(store: DataFrame, path: str) -> None:
    """Write which trigrams each file of a store read from ``path`` holds, as bits by a hash: at most 8 KiB a file.

    Command and text are taken as ``search_like`` compares them. The bits are set in Arrow and leave a task once per file.
    """
    places, bits, at_once = _trigram_places(), SIGNATURE_BITS, 256

    def signed(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def masks(file: str, seen: Any) -> Any:
            words = np.packbits(seen, bitorder="little").view("<i8")
            held = np.flatnonzero(words)
            return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(file, pa.string()), len(held)), pa.array(held), pa.array(words[held])], ["file", "word", "mask"])

        known, seen = None, np.zeros(bits, dtype=bool)
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                rows = batch.slice(at, at_once)
                # As bytes first: a text that is no valid UTF-8 is read like any other.
                texts = [[(x or b"").decode(errors="replace") for x in rows.column(k).cast(pa.binary()).to_pylist()] for k in range(1, rows.num_columns)]
                for file, *own in zip(rows.column(0).to_pylist(), *texts, strict=True):
                    if file != known:
                        if known is not None:
                            yield masks(known, seen)
                        known, seen = file, np.zeros(bits, dtype=bool)
                    for text in own:
                        seen[places(text)] = True
        if known is not None:
            yield masks(known, seen)

    rows = store.select(F.col("_metadata.file_path").alias("file"), *[F.col(c).cast("string").alias(c) for c in FIELDS])
    found = rows.mapInArrow(signed, "file string, word bigint, mask bigint")
    found.groupBy("file", "word").agg(F.bit_or("mask").alias("mask")).write.mode("overwrite").parquet(signatures_path(path))


def files_with(spark: SparkSession, path: str, query: str) -> list[str]:
    """Files of the store at ``path`` that may hold a row for ``search_like``: those with all trigrams of the query, and those without a signature."""
    every = spark.read.parquet(path).inputFiles()
    places = _trigram_places()
    masks: dict[int, int] = {}
    for at in sorted({int(x) for run in re.split("[%_]", query) for x in places(run)}):
        masks[at // 64] = masks.get(at // 64, 0) | 1 << at % 64
    if not masks:
        return every
    signed = {w: m - (1 << 64) if m >> 63 else m for w, m in masks.items()}
    asked = F.array(*(F.struct(F.lit(w).cast("long").alias("word"), F.lit(m).cast("long").alias("wanted")) for w, m in signed.items()))
    wanted = spark.range(1).select(F.explode(asked).alias("w")).select("w.*")
    known = spark.read.parquet(signatures_path(path))
    met = known.join(F.broadcast(wanted), "word").filter(F.col("mask").bitwiseAND(F.col("wanted")) == F.col("wanted")).groupBy("file").agg(F.count(F.lit(1)).alias("met"))
    all_met = met.filter(F.col("met") == len(signed)).select("file", F.lit(True).alias("may"))
    # The driver has to name the files to be read, so their names come to it.
    plain = lambda f: re.sub(r"^\w+:/*", "", f)  # a listing and a row may spell the scheme differently
    judged = {plain(r["file"]): r["may"] for r in known.select("file").distinct().join(all_met, "file", "left").collect()}
    return [f for f in every if judged.get(plain(f), True)]


def search_like_in(spark: SparkSession, path: str, query: str, limit: int = 10) -> DataFrame:
    """``search_like`` on a written store with signatures: files that cannot hold the text are not read."""
    store = spark.read.option("mergeSchema", "true").option("basePath", path).parquet(path)
    files = files_with(spark, path, query)
    found = spark.read.schema(store.schema).option("basePath", path).parquet(*files) if files else store.limit(0)
    return search_like(found, query, limit)


def query_pattern(query: str) -> str:
    lowered = query.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    return "%" + lowered.replace("\\", "\\\\") + "%"


def search(store: DataFrame, index: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Word search; substring search when the query is none or no row matches it."""
    try:
        hits = saved(newest_hits(index, query, limit), "hits")
    except NotAQuery:
        return search_like(store, query, limit)
    if hits.isEmpty():
        return search_like(store, query, limit)
    return store.join(F.broadcast(hits), "id").orderBy(F.desc("ts"), "id")
