"""Removal of repeated multi-line chunks with content-defined boundaries, and of all repeated passages, on SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartmill.llm.common import text_of, write_table

# a line is a mark with a chance of one in this many; prime to mix the rolling hash
CHUNK_LINES = 3
PRIME = 1_000_003
# a line of so many words is a chunk, or a passage, of its own
LEAST_WORDS = 20


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a lambda's argument stands for it."""
    return F.transform(F.array(value), body)[0]


def _chunks(lines: Column, chunk_lines: int) -> Column:
    """Chunks of an array of lines as structs of number, first line from 0 and number of lines.

    A line is a mark when the rolling hash of its and the previous line's
    hashes is a multiple of ``chunk_lines``. A boundary falls behind a mark
    that follows no mark, so no two boundaries are neighbours, all chunks but
    the last have two lines or more, and a boundary depends on three lines
    alone and moves with them.
    """
    hashes = F.transform(lines, lambda line: F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("bigint"))

    def mark(h: Column, i: Column, before: Column) -> Column:
        return (h + 31 * F.coalesce(F.get(before, i - 1), F.lit(0))) % PRIME % chunk_lines == 0

    def boundary(here: Column, i: Column, all_marks: Column) -> Column:
        return F.when((here & ~F.coalesce(F.get(all_marks, i - 1), F.lit(False))) | (i == F.size(all_marks) - 1), i)

    marks = _let(hashes, lambda hs: F.transform(hs, lambda h, i: mark(h, i, hs)))
    ends = _let(marks, lambda ms: F.filter(F.transform(ms, lambda m, i: boundary(m, i, ms)), lambda i: i.isNotNull()))

    def chunk(end: Column, k: Column, all_ends: Column) -> Column:
        first = F.coalesce(F.get(all_ends, k - 1) + 1, F.lit(0))
        return F.struct(k.alias("no"), first.alias("first"), (end - first + 1).alias("n"))

    return _let(ends, lambda es: F.transform(es, lambda e, k: chunk(e, k, es)))


def _comparable(lines: Column, chunks: Column, least_words: int) -> Column:
    """What is compared: chunks of two lines or more that are not blank, and lines of ``least_words`` words, with the number of their chunk."""
    # reads a line as far as its last word that counts
    enough = rf"^[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){{{least_words - 1}}}[^\x20\x09-\x0D]"

    def long_lines(c: Column) -> Column:
        at = F.filter(F.sequence(c["first"], c["first"] + c["n"] - 1), lambda i: F.get(lines, i).rlike(enough))
        return F.transform(at, lambda i: F.struct(c["no"].alias("no"), i.alias("first"), F.lit(1).alias("n")))

    whole = F.filter(chunks, lambda c: (c["n"] >= 2) & F.exists(F.slice(lines, c["first"] + 1, c["n"]), lambda line: F.trim(line) != ""))
    return F.concat(whole, F.flatten(F.transform(chunks, long_lines)))


def _flags(places: Column, n: Column) -> Column:
    """For each of ``n`` lines whether it is among ``places``."""
    def sides(found: Column) -> Column:
        others = F.array_except(F.sequence(F.lit(0), n - 1), found)
        return F.concat(F.transform(found, lambda i: F.struct(i.alias("at"), F.lit(True).alias("is"))), F.transform(others, lambda i: F.struct(i.alias("at"), F.lit(False).alias("is"))))

    return F.transform(F.array_sort(_let(places, sides)), lambda x: x["is"])


def _around(lines: Column, chunks: Column, u: Column, taken: Column | None = None) -> Column:
    """Lines before (nearest first) and behind a unit, as far as the second chunk from its own reaches or until a taken line."""
    low = F.get(chunks, F.greatest(u["no"] - 2, F.lit(0)))["first"]
    far = F.get(chunks, F.least(u["no"] + 2, F.size(chunks) - 1))
    high, last = far["first"] + far["n"] - 1, u["first"] + u["n"] - 1
    if taken is not None:
        before = F.filter(F.sequence(low, u["first"] - 1), lambda i: F.get(taken, i))
        low = F.when((u["first"] == low) | F.get(taken, u["first"] - 1), u["first"]).otherwise(F.coalesce(F.array_max(before) + 1, low))
        behind = F.filter(F.sequence(last + 1, high), lambda i: F.get(taken, i))
        high = F.when((last == high) | F.get(taken, last + 1), last).otherwise(F.coalesce(F.array_min(behind) - 1, high))
    return F.struct(F.reverse(F.slice(lines, low + 1, u["first"] - low)).alias("before"), F.slice(lines, last + 2, high - last).alias("behind"))


def _agreeing(a: Column, b: Column) -> Column:
    """How many lines two arrays have in common from their start on."""
    return _let(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda same: F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, F.size(same).cast("bigint")))


def _units(lines: Column, least_words: int) -> Column:
    """Every two neighbouring lines, and every line of ``least_words`` words, as structs like ``_chunks``.

    Blank lines start and end no unit; those between two neighbours belong to
    their unit. Equal units of either kind have numbers in the order of their
    places.
    """
    words = F.transform(lines, lambda line: F.size(F.filter(F.split(line, r"[\x20\x09-\x0D]+"), lambda w: w != "")))
    spoken = F.transform(F.array(words), lambda ws: F.filter(F.transform(ws, lambda n, i: F.struct(i.alias("at"), n.alias("words"))), lambda s: s["words"] > 0))[0]

    def unit(s: Column, k: Column, all_lines: Column) -> Column:
        after = F.get(all_lines, k + 1)["at"]
        pair = F.struct((2 * k).alias("no"), s["at"].alias("first"), (after - s["at"] + 1).alias("n"))
        alone = F.struct((2 * k + 1).alias("no"), s["at"].alias("first"), F.lit(1).alias("n"))
        return F.array(F.when(after.isNotNull(), pair), F.when(s["words"] >= least_words, alone))

    units = F.transform(F.array(spoken), lambda ss: F.flatten(F.transform(ss, lambda s, k: unit(s, k, ss))))[0]
    return F.filter(units, lambda u: u.isNotNull())


def _body(lines: Column, chunk: Column) -> Column:
    return F.when(chunk["n"] == 1, F.get(lines, chunk["first"])).otherwise(F.array_join(F.slice(lines, chunk["first"] + 1, chunk["n"]), "\n"))


UNIT = "struct<no:int,first:int,n:int>"


def dedup_lines(docs: DataFrame, chunk_lines: int = CHUNK_LINES, least_words: int = LEAST_WORDS) -> DataFrame:
    """Texts without the content-defined chunks that stand elsewhere before, and the equal lines around them.

    Returns ``doc_id, text, n_lines, removed_lines, removed_chunks`` for every
    row. Compared are chunks of two lines or more, and as chunks of their own
    lines of ``least_words`` words; blank chunks are left alone. Of equal ones
    that in the smallest document, there the first one, stays. They are found
    by a 128-bit hash, and one is removed only if its bytes are those of the
    chunk that stays; a chunk that merely shares the hash stays as well.

    A removed chunk then grows over the lines before and behind it as long as
    they are, byte by byte, those around the chunk that stays, at most to the
    far end of the second chunk from its own: a passage's first and last lines
    share a chunk with its neighbours. What goes stands at an earlier place
    with the same bytes, so the first place of a line is never removed.

    What is shuffled for all chunks is a hash, a document and a place; it is
    combined before the shuffle, so a chunk that very many documents repeat is
    a few rows, and the join back to its places can be split. Texts are
    shuffled once, to meet the list of their own repeated chunks; those with a
    chunk to grow, or to grow along, once more.

    Null texts count as empty; an empty text is one line. A row without id
    keeps its text and is no source for others. Repeated rows (same id, same
    text) keep and lose the same chunks. Extra columns are not read.
    """
    texts = docs.select("doc_id", text_of().alias("text")).withColumn("version", F.xxhash64("text"))
    lines, key = F.split("text", "\n"), ["doc_id", "version"]

    def cut(*more: Column) -> Column:
        return _let(lines, lambda ls: F.struct(ls.alias("lines"), _chunks(ls, chunk_lines).alias("chunks"), *more))

    units = _let(cut(), lambda s: F.transform(_comparable(s["lines"], s["chunks"], least_words), lambda u: F.struct(u.alias("u"), F.unhex(F.md5(_body(s["lines"], u))).alias("h"))))
    places = texts.filter("doc_id IS NOT NULL").select(*key, units.alias("units")).select(*key, F.explode("units").alias("x"))
    places = write_table(places.select(*key, "x.u", "x.h"), "line-chunks")

    first = F.min(F.struct("doc_id", "u.first", "version")).alias("first")
    # equal rows of a document are one place
    repeated = places.groupBy("h").agg(F.count("*").alias("times"), first).filter("times > 1").select("h", "first")
    stays = (F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.first") == F.col("u.first")) & (F.col("first.version") == F.col("version"))
    hits = places.join(repeated, "h").select(*key, F.struct("u", "h", stays.alias("stays")).alias("hit"))
    # one document's own chunks, each once
    per_doc = hits.groupBy(*key).agg(F.collect_set("hit").alias("hits"))
    marked = write_table(texts.join(per_doc, key, "left"), "line-marked")

    spelt = _let(F.struct(lines.alias("lines"), "hits"), lambda s: F.transform(
        s["hits"], lambda x: F.struct(x["u"].alias("u"), x["h"].alias("h"), x["stays"].alias("stays"), _body(s["lines"], x["u"]).alias("body"))))
    found = marked.filter("hits IS NOT NULL").select(*key, F.explode(spelt).alias("x")).select(*key, "x.u", "x.h", "x.stays", "x.body")
    kept = write_table(found.filter("stays").groupBy("h").agg(F.first("body").alias("kept_body")), "line-kept")
    other = found.filter("NOT stays").join(kept, "h").filter("body <> kept_body")
    differing = write_table(other.select(*key, F.struct("u", "h").alias("x")), "line-differing")

    no_hits = F.array().cast(f"array<struct<u:{UNIT},h:binary,stays:boolean>>")
    gone = F.transform(F.filter(F.coalesce("hits", no_hits), lambda x: ~x["stays"]), lambda x: F.struct(x["u"].alias("u"), x["h"].alias("h")))
    removed = marked.withColumn("gone", gone)
    if not differing.isEmpty():
        spared = differing.groupBy(*key).agg(F.collect_set("x").alias("spared"))
        removed = removed.join(spared, key, "left").withColumn("gone", F.array_except("gone", F.coalesce("spared", F.array().cast(f"array<struct<u:{UNIT},h:binary>>")))).drop("spared")

    # removed chunks with lines around them that no chunk takes along
    covered = F.array_distinct(F.flatten(F.transform("gone", lambda x: F.sequence(x["u"]["first"], x["u"]["first"] + x["u"]["n"] - 1))))
    around = _let(cut(F.col("gone").alias("gone"), _flags(covered, F.size(lines)).alias("taken")), lambda s: F.transform(
        s["gone"], lambda x: F.struct(x["u"].alias("u"), x["h"].alias("h"), _around(s["lines"], s["chunks"], x["u"], s["taken"]).alias("own"))))
    edges = F.filter(around, lambda x: (F.size(x["own"]["before"]) > 0) | (F.size(x["own"]["behind"]) > 0))
    edges = removed.filter(F.size("gone") > 0).select(*key, F.explode(edges).alias("x"))
    edges = write_table(edges.select(*key, "x.u", "x.h", "x.own"), "line-edges")

    sources = marked.select(*key, F.explode("hits").alias("x")).filter("x.stays").select(*key, F.struct("x.u", "x.h").alias("x"), "x.h")
    sources = sources.join(edges.select("h").distinct(), "h", "left_semi").groupBy(*key).agg(F.collect_set("x").alias("kept"))
    beside = _let(cut(F.col("kept").alias("kept")), lambda s: F.transform(s["kept"], lambda x: F.struct(x["h"].alias("h"), _around(s["lines"], s["chunks"], x["u"]).alias("first"))))
    sources = marked.filter(F.exists("hits", lambda x: x["stays"])).select(*key, "text").join(sources, key).select(F.explode(beside).alias("x"))
    sources = sources.select("x.h", "x.first").groupBy("h").agg(F.first("first").alias("first"))
    grown = edges.join(sources, "h").select(*key, "u", _agreeing(F.col("own.before"), F.col("first.before")).cast("int").alias("a"), _agreeing(F.col("own.behind"), F.col("first.behind")).cast("int").alias("b"))
    last = F.col("u.first") + F.col("u.n") - 1
    none = F.array().cast("array<int>")
    added = F.concat(F.when(F.col("a") > 0, F.sequence(F.col("u.first") - F.col("a"), F.col("u.first") - 1)).otherwise(none), F.when(F.col("b") > 0, F.sequence(last + 1, last + F.col("b"))).otherwise(none))
    grown = write_table(grown.filter("a > 0 OR b > 0").groupBy(*key).agg(F.array_distinct(F.flatten(F.collect_set(added))).alias("added")), "line-grown")  # one document's lines

    at = removed.withColumn("covered", covered)
    open_ended = F.size("covered").between(1, F.size(lines) - 1)
    joined = at.filter(open_ended).join(grown, key, "left")
    final = joined.unionByName(at.filter(~open_ended).withColumn("added", none))
    final = final.select("doc_id", "text", "gone", lines.alias("lines"), F.array_union("covered", F.coalesce("added", none)).alias("out"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("out"))
    cleaned = _let(F.col("lines"), lambda ls: F.array_join(F.transform(left, lambda k: F.get(ls, k)), "\n"))
    return final.select(
        "doc_id", F.when(F.size("out") == 0, F.col("text")).otherwise(cleaned).alias("text"), F.size("lines").cast("bigint").alias("n_lines"),
        F.size("out").cast("bigint").alias("removed_lines"), F.size("gone").cast("bigint").alias("removed_chunks"),
    )


def dedup_passages(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Texts without the passages that stand elsewhere before, whatever their length and place.

    Returns ``doc_id, text, n_lines, removed_lines`` for every row. A passage
    is two neighbouring lines or more, or one line of ``least_words`` words.
    All pairs of neighbours and all such lines are compared, so a passage goes
    as a whole, with its first and last line. Of equal ones that in the
    smallest document, there the first one, stays. Whatever goes stands at an
    earlier place with the same bytes, so the first place of a line is never
    removed. Hashes, shuffles and odd rows are those of ``dedup_lines``.
    """
    texts = docs.select("doc_id", text_of().alias("text")).withColumn("version", F.xxhash64("text"))

    def with_units(rows: DataFrame, *more: str) -> DataFrame:
        lines = rows.select("doc_id", "version", "text", F.split("text", "\n").alias("lines"), *more)
        return lines.withColumn("units", _units(F.col("lines"), least_words))

    # hashed within the row: an exploded unit carries no lines
    hashed = F.transform(F.array(F.struct("lines", "units")), lambda s: F.transform(s["units"], lambda u: F.struct(u.alias("u"), F.unhex(F.md5(_body(s["lines"], u))).alias("h"))))[0]
    places = with_units(texts.filter("doc_id IS NOT NULL")).select("doc_id", "version", hashed.alias("hashed"))
    places = places.select("doc_id", "version", F.explode("hashed").alias("x")).select("doc_id", "version", "x.u", "x.h")
    places = write_table(places, "passage-units")

    first = F.min(F.struct("doc_id", "u", "version")).alias("first")
    repeated = places.groupBy("h").agg(F.count("*").alias("times"), first).filter("times > 1").select("h", "first")
    stays = (F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.u.no") == F.col("u.no")) & (F.col("first.version") == F.col("version"))
    hits = places.join(repeated, "h").select("doc_id", "version", F.struct("u", "h", stays.alias("stays")).alias("hit"))
    per_doc = hits.groupBy("doc_id", "version").agg(F.collect_set("hit").alias("hits"))
    marked = write_table(texts.join(per_doc, ["doc_id", "version"], "left"), "passage-marked")

    spelt = F.transform(F.array(F.struct(F.split("text", "\n").alias("lines"), "hits")), lambda s: F.transform(
        s["hits"], lambda x: F.struct(x["u"].alias("u"), x["h"].alias("h"), x["stays"].alias("stays"), _body(s["lines"], x["u"]).alias("body"))))[0]
    found = marked.filter("hits IS NOT NULL").select("doc_id", "version", F.explode(spelt).alias("x")).select("doc_id", "version", "x.u", "x.h", "x.stays", "x.body")
    kept = write_table(found.filter("stays").groupBy("h").agg(F.first("body").alias("kept_body")), "passage-kept")
    other = found.filter("NOT stays").join(kept, "h").filter("body <> kept_body")
    differing = write_table(other.select("doc_id", "version", "u"), "passage-differing")

    unit = "array<struct<no:int,first:int,n:int>>"
    gone = F.transform(F.filter(F.coalesce("hits", F.array().cast("array<struct<u:struct<no:int,first:int,n:int>,h:binary,stays:boolean>>")), lambda x: ~x["stays"]), lambda x: x["u"])
    final = marked.withColumn("gone", gone)
    if not differing.isEmpty():
        spared = differing.groupBy("doc_id", "version").agg(F.collect_set("u").alias("spared"))
        final = final.join(spared, ["doc_id", "version"], "left").withColumn("gone", F.array_except("gone", F.coalesce("spared", F.array().cast(unit))))
    places_gone = F.array_distinct(F.flatten(F.transform("gone", lambda u: F.sequence(u["first"], u["first"] + u["n"] - 1))))
    final = final.select("doc_id", "text", F.split("text", "\n").alias("lines"), places_gone.alias("gone"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    cleaned = F.transform(F.array(F.col("lines")), lambda ls: F.array_join(F.transform(left, lambda k: F.get(ls, k)), "\n"))[0]
    return final.select(
        "doc_id", F.when(F.size("gone") == 0, F.col("text")).otherwise(cleaned).alias("text"),
        F.size("lines").cast("bigint").alias("n_lines"), F.size("gone").cast("bigint").alias("removed_lines"),
    )
