"""Document fingerprints: a canonical exact digest, in SQL functions alone.

Canonical text: compatibility normalisation (NFKC), full case folding, NFKC again, every run of white space
one space, none at the ends. Its 128-bit key is two chained XXH64 values; rows with equal keys are grouped and
their canonical bytes compared. Where a group holds more than one text (a collision of the hash), each distinct
text of it gets a numbered suffix, so equal fingerprints always mean equal canonical bytes.

Spark has no SQL function for Unicode normalisation; ``reflect`` calls the Unicode library that Spark's own
collations use. Only texts with a character beyond ASCII take that way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free_name, is_missing, partitions

#: Second seed of the wide hash: hashed in before the text.
SALT = "loomtext digest"
#: Slices of the id order for each shuffle partition.
SLICES = 4
#: Largest bitmap of keys: 64 MB.
MOST_BITS = 1 << 29
_NORMAL = "com.ibm.icu.text.Normalizer"
_LETTER = "com.ibm.icu.lang.UCharacter"


def _canonical_sql(text: str) -> str:
    nfkc = f"reflect('{_NORMAL}', 'compose', {text}, true)"
    folded = f"reflect('{_NORMAL}', 'compose', reflect('{_LETTER}', 'foldCase', {nfkc}, true), true)"
    plain = f"if({text} rlike '[^\\\\x00-\\\\x7F]', {folded}, lower({text}))"
    return f"trim(regexp_replace({plain}, '[\\\\s\\\\x0B\\\\x1C-\\\\x1F\\\\x85\\\\p{{Z}}]+', ' '))"


def canonical(text_col: str) -> Column:
    """The canonical form of a column that holds no nulls."""
    return F.expr(_canonical_sql(f"`{text_col}`"))


def keys(df: DataFrame, canon: str, high: str, low: str) -> DataFrame:
    """df with the two halves of the wide key of the canonical text in column canon."""
    return df.withColumns({high: F.xxhash64(F.col(canon)), low: F.xxhash64(F.lit(SALT), F.col(canon))})


def _bit(h: str, bits: int) -> tuple[str, str]:
    """SQL for the part of a bitmap of so many bits that key h falls in, and for its place there."""
    return f"pmod({h}, {bits}L) div 32768L", f"cast(pmod({h}, {bits}L) % 32768L as int)"


def _bitmap(keys_: DataFrame) -> tuple[DataFrame, int]:
    """keys (h) -> a bitmap of them as (part, bitmap), of at most MOST_BITS bits, and its number of bits."""
    bits = min(MOST_BITS, max(1 << 20, 1 << (16 * keys_.count() - 1).bit_length()))
    part, at = _bit("h", bits)
    return keys_.select(F.expr(part).alias("part"), F.expr(at).alias("at")).groupBy("part").agg(F.bitmap_construct_agg("at").alias("bitmap")), bits


def _seen(rows: DataFrame, h: str, maps: tuple[DataFrame, int], out: str) -> DataFrame:
    """rows with a flag ``out``: whether key h may be among those of the bitmap; false only if it is not.

    The bitmap is broadcast: MOST_BITS bounds it at 64 MB.
    """
    table, bits = maps
    part, at = _bit(f"`{h}`", bits)
    p, m = free_name(rows, "part"), free_name(rows, "bitmap")
    own = F.broadcast(table.select(F.col("part").alias(p), F.col("bitmap").alias(m)))
    bit = f"shiftright(cast(conv(hex(substring({m}, {at} div 8 + 1, 1)), 16, 10) as int), {at} % 8) & 1 = 1"
    return rows.withColumn(p, F.expr(part)).join(own, p, "left").withColumn(out, F.coalesce(F.expr(bit), F.lit(False))).drop(p, m)


def _differing(met: DataFrame) -> DataFrame | None:
    """(h, l, canon) -> keys (h, l) that more than one text has, None if there are none.

    The least and the greatest bytes of each key are summed up in every task before the shuffle: a key whose least
    and greatest are equal has one text.
    """
    ends = cut(met.groupBy("h", "l").agg(F.min("canon").alias("a"), F.max("canon").alias("b")).filter("a <> b").select("h", "l"))
    return None if ends.isEmpty() else ends


def _numbered(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """rows (h, l, canon) -> (h, l, canon, n): the texts of the keys in ends, numbered."""
    texts = rows.join(ends, ["h", "l"], "left_semi").distinct()
    return cut(texts.withColumn("n", F.row_number().over(Window.partitionBy("h", "l").orderBy("canon"))))


def collisions(rows: DataFrame) -> DataFrame | None:
    """rows (h, l, canon) -> (h, l, canon, n): the texts of keys that more than one text has, numbered; None if none has.

    Keys are counted first. A bitmap of the keys with several rows lets the other rows go before anything is
    moved; what it lets through by chance does no harm.
    """
    several = cut(rows.groupBy("h", "l").count().filter("count > 1").select("h", "l"))
    if several.isEmpty():
        return None
    ends = _differing(_seen(rows, "h", _bitmap(several), "met").filter("met").select("h", "l", "canon"))
    return None if ends is None else _numbered(rows, ends)


def print_hex(high: str, low: str) -> Column:
    """32 lowercase hex digits of a wide key."""
    return F.lower(F.concat(F.lpad(F.hex(high), 16, "0"), F.lpad(F.hex(low), 16, "0")))


def _printed(rows: DataFrame, high: str, low: str, canon: str, clash: DataFrame | None, out: str) -> DataFrame:
    """rows with their fingerprint in column ``out``: the key, and the text's number where its key has several texts."""
    plain = print_hex(high, low)
    if clash is None:
        return rows.withColumn(out, plain)
    h, l, c, n = (free_name(rows, x) for x in ("clash_h", "clash_l", "clash_canon", "clash_n"))  # noqa: E741
    own = clash.select(F.col("h").alias(h), F.col("l").alias(l), F.col("canon").alias(c), F.col("n").alias(n))
    met = rows.join(own, (F.col(high) == F.col(h)) & (F.col(low) == F.col(l)) & (F.col(canon) == F.col(c)), "left")
    return met.withColumn(out, F.concat(plain, F.coalesce(F.concat(F.lit("-"), F.col(n).cast("string")), F.lit("")))).drop(h, l, c, n)


def fingerprints(docs: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs with a column ``out``: 32 hex digits, and a suffix where texts collide.

    Null text counts as empty; texts of white space alone equal the empty one. Very long texts are hashed whole.
    Repeated rows and any other columns are kept as they are; scratch columns avoid their names. No rows give no rows.
    """
    text, canon, high, low = (free_name(docs, x) for x in ("text", "canon", "h", "l"))
    df = docs.withColumn(text, is_missing(F.col(text_col).cast("string"))).withColumn(canon, canonical(text))
    df = keys(df, canon, high, low)
    clash = collisions(df.select(F.col(high).alias("h"), F.col(low).alias("l"), F.col(canon).alias("canon")))
    made = free_name(docs, "print")
    done = _printed(df, high, low, canon, clash, made)
    return done.select(*[F.col(c) for c in docs.columns if c != out], F.col(made).alias(out))


#: Places of a row in the order: rows without an id last, ids descending, then the text's key.
PLACE = "struct(doc_id is null as z, coalesce(~doc_id, 0L) as k, h as h, l as l)"
#: Rows of the sample that bounds one slice, about.
SAMPLED = 24


def _bounds(places: DataFrame, n: int) -> DataFrame:
    """(place), distinct -> one row (coarse, fine, step): first places of n slices of the order, but for the first slice.

    The places are those of a sample by hash, of a size that goes with the number of slices alone.
    """
    every = max(1, places.count() // (SAMPLED * n))
    sample = sorted(tuple(r.place) for r in places.filter(F.pmod(F.xxhash64("place", F.lit(n)), F.lit(every)) == 0).collect())
    tops = sample[SAMPLED // 2 :: SAMPLED] if every > 1 else sample[1 :: max(1, len(sample) // n)]
    step = max(1, int(len(tops) ** 0.5))
    fine = [tops[i : i + step] for i in range(0, len(tops), step)]
    kind = places.schema["place"].dataType.simpleString()
    return places.sparkSession.createDataFrame([([g[0] for g in fine], fine, step)], f"coarse array<{kind}>, fine array<array<{kind}>>, step int")


def _dealt(rows: DataFrame, places: DataFrame, slices: int | None) -> DataFrame:
    """rows (doc_id, h, l, ...), alike in none of the three -> rows with slice and guest, for windows over the next row.

    The first row of each slice, and the first of all for the last slice, is there a second time as a guest at the
    end of the slice before. A slice begins at a place that a row has. The bounds are read by a scalar subquery.
    """
    n = slices or SLICES * partitions(rows.sparkSession)
    bounds = _bounds(places, n)
    first = places.agg(F.min("place").alias("first"))
    one = lambda c: bounds.select(c).scalar()
    df = rows.withColumn("place", F.expr(PLACE)).withColumns({"coarse": one("coarse"), "fine": one("fine"), "step": one("step"), "first": first.scalar()})
    df = df.withColumn("g", F.expr("size(filter(coarse, b -> b <= place))"))
    df = df.withColumn("f", F.expr("if(g = 0, 0, size(filter(element_at(fine, greatest(g, 1)), b -> b <= place)))"))
    df = df.withColumn("here", F.expr("if(g = 0, 0, (g - 1) * step + f)")).withColumn("last", F.expr("if(size(fine) = 0, 0, (size(fine) - 1) * step + size(element_at(fine, -1)))"))
    is_first = "(place = first or (g > 0 and place = element_at(element_at(fine, greatest(g, 1)), greatest(f, 1))))"
    back = "if(here = 0, last, here - 1)"
    seats = f"if({is_first}, array(struct(here as s, false as g), struct({back} as s, true as g)), array(struct(here as s, false as g)))"
    return df.select(*rows.columns, F.explode(F.expr(seats)).alias("seat")).select(*rows.columns, F.col("seat.s").alias("slice"), F.col("seat.g").alias("guest"))


def _units(rows: DataFrame, many: DataFrame | None) -> DataFrame:
    """rows (doc_id, text, h, l) -> those and n: rows alike in id and key, which are listed in many, are one with their number.

    Rows that have no like go by a bitmap and are not moved; the others are put together in each task first.
    """
    if many is None:
        return rows.withColumn("n", F.lit(1).cast("long"))
    flagged = _seen(rows, "h", _bitmap(many.select("h")), "met")
    alone = flagged.filter("not met").drop("met").withColumn("n", F.lit(1).cast("long"))
    alike = flagged.filter("met").groupBy("doc_id", "h", "l").agg(F.first("text").alias("text"), F.count("*").alias("n"))
    return alone.unionByName(alike.select(*alone.columns))


def _after(rows: DataFrame, many: DataFrame | None, places: DataFrame, slices: int | None) -> DataFrame:
    """rows -> those with next (text, h, l): of rows alike all but one are followed by a like one."""
    units = _units(rows, many)
    dealt = _dealt(units, places, slices)
    order = Window.partitionBy("slice").orderBy(F.col("guest"), F.col("doc_id").desc_nulls_last(), "h", "l")
    after = dealt.withColumn("next", F.lead(F.struct("text", "h", "l")).over(order)).filter(~F.col("guest"))
    if many is None:
        return after.drop("slice", "guest", "n")
    alone = after.filter("n = 1")
    rest = after.filter("n > 1").withColumn("at", F.explode(F.expr(f"sequence(0L, n - 1, {SPREAD}L)")))
    rest = rest.repartition(partitions(units.sparkSession), "doc_id", "h", "at").withColumn("nth", F.explode(F.expr(f"sequence(at, least(n, at + {SPREAD}) - 1)")))
    rest = rest.withColumn("next", F.expr("if(nth = 0, next, struct(text as text, h as h, l as l))"))
    return alone.unionByName(rest.select(*after.columns)).drop("slice", "guest", "n")


#: Rows alike that one row is spread out to at once.
SPREAD = 4096
_EDIT = "concat(substring(text, 1, length(text) - length(text) div 2), substring(coalesce(next.text, ''), 1, length(text) div 2))"


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slices: int | None = None) -> DataFrame:
    """docs -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many (or
    all) of the next document, by descending id and after the last the first. Ids that repeat are ordered by
    their text's key, rows without an id come last, in the order of these keys; of rows alike in both all but the last
    are followed by one of their own. Null text counts as empty; very long texts are taken whole; no rows give no
    rows; other columns are not looked at, whatever their names.

    A digest is exact: likeness is 1 for equal canonical bytes, else 0. Wherever two keys are equal the bytes are
    compared: inside a row for likeness, and by key over all texts, own and edited, for the fingerprints.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), is_missing(F.col(text_col).cast("string")).alias("text"))
    own = keys(rows.withColumn("canon", canonical("text")), "canon", "h", "l")
    key_rows = cut(own.select("doc_id", "h", "l"))
    places = cut(key_rows.distinct().select(F.expr(PLACE).alias("place")))
    many = cut(key_rows.groupBy("doc_id", "h", "l").count().filter("count > 1").select("doc_id", "h", "l"))
    many = None if many.isEmpty() else many
    own_texts, rows = own.select("h", "l", "canon"), own.drop("canon")

    def followed(table: DataFrame) -> DataFrame:
        return _after(table, many, places, slices).withColumn("edit", F.expr(_EDIT))

    after = keys(followed(rows).withColumn("canon", canonical("edit")), "canon", "eh", "el")
    alike = lambda h, l, text: F.expr(f"cast(h = {h} and l = {l} and {_canonical_sql('text')} = {text} as double)")  # noqa: E731, E741
    facts = cut(
        after.select(
            "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edit", 256).alias("edited_sha256"), "h", "l", "eh", "el",
            F.expr("coalesce(next.h, h)").alias("nh"), F.coalesce(alike("eh", "el", "canon"), F.lit(0.0)).alias("near_edited"),
            F.coalesce(alike("next.h", "next.l", _canonical_sql("next.text")), F.lit(0.0)).alias("near_next"),
        )
    )
    several = facts.select("h", "l").unionByName(facts.select(F.col("eh").alias("h"), F.col("el").alias("l")))
    several = cut(several.groupBy("h", "l").count().filter("count > 1").select("h", "l"))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    plain = facts.withColumns({"fingerprint": print_hex("h", "l"), "edited_fingerprint": print_hex("eh", "el")}).select(*names)
    if several.isEmpty():
        return plain
    maps = _bitmap(several)
    met = _seen(own_texts, "h", maps, "met").filter("met").select("h", "l", "canon")
    edits = cut(_seen(facts, "eh", maps, "met").filter("met").select("h", "nh", "eh", "el"))
    if not edits.isEmpty():
        wanted = _bitmap(edits.select(F.explode(F.array("h", "nh")).alias("h")).distinct())
        blank = _seen(rows, "h", wanted, "met").withColumn("text", F.expr("if(met, text, '')")).drop("met")
        again = keys(followed(blank).withColumn("canon", canonical("edit")), "canon", "eh", "el").select(F.col("eh").alias("h"), F.col("el").alias("l"), "canon")
        met = met.unionByName(_seen(again, "h", maps, "met").filter("met").select("h", "l", "canon"))
    ends = _differing(met)
    if ends is None:
        return plain
    full = after.select(*[c for c in after.columns if c != "next"], F.col("next.h").alias("nh"), F.col("next.l").alias("nl"), F.col("next.text").alias("next_text"))
    clash = _numbered(own_texts.unionByName(after.select(F.col("eh").alias("h"), F.col("el").alias("l"), "canon")), ends)
    full = full.withColumn("own_canon", canonical("text"))
    full = _printed(full, "h", "l", "own_canon", clash, "fingerprint")
    full = _printed(full, "eh", "el", "canon", clash, "edited_fingerprint")
    same = lambda c: F.coalesce((F.col("own_canon") == c).cast("double"), F.lit(0.0))
    return full.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edit", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        same(F.col("canon")).alias("near_edited"), same(canonical("next_text")).alias("near_next"),
    )
