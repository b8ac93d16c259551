"""Benchmark decontamination by template canonicalisation (native).

A text becomes words (runs of letters, marks and digits, in lower case).  In its
*template* a number, a name and a unit behind a number are typed placeholders.  A
name is a capitalised word inside a sentence, and, in a reading of its own, any
capitalised word, as a name can start a sentence; 1,200 and 5.50 are read as two
words and as one.  (The SQL has neither.  Every call looks at all readings; ``matches`` also
tells of the *plain* windows, those that the SQL's readings show, and ``query`` takes its rows from these.)
Windows of ``words`` template words of
all texts meet those of the benchmark in a hash join; a hit counts if the slots
are consistent: equal values stay equal and different ones stay different, so a
question with other numbers and names is caught, and a chance pattern is not.
Windows come with and without names as slots (in the SQL, the benchmark's alone do),
so that copies in capitals or lower case throughout, which show no names, are caught
as well, and so is a copy whose first word another text's middle makes a name.

An item with fewer words is one window of its own length.  A window with literal
words in less than half its places would match any table of numbers, and an item
under ``least`` words any talk: these are met by equal values only.  A window of
numbers and units alone is met by none.  (So an item of one or two common words
finds every text that has these: leave such items out if that is not wanted.)
Null and empty texts have no windows.  Rows with equal
ids count as one document in the result, rows without an id too; ``decontaminate``
tells the latter apart by their texts.  Empty tables give no rows; extra
columns of either table are ignored (results name only their own).

Scale: no shuffle of texts; windows are hashed inside the row, and only hits
leave the join.  The benchmark's windows are broadcast while they are no more than
``BROADCAST_WINDOWS`` and their slots' texts ``BROADCAST_BYTES``, and a bitmap of their hashes and of hashes of three words
of each spares the texts' windows that have none of these; beyond that number every window is
joined in a shuffle.  Both ways give the same rows.
"""

from __future__ import annotations

from functools import partial, reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, select_by_id, table

WORDS, LEAST, BROADCAST_WINDOWS, BROADCAST_BYTES = 13, 5, 2_000_000, 128 << 20
NAME, NUMBER, UNIT = "\x01", "\x02", "\x03"
#: Units of measure, behind a number.  (Fixed values.)
UNITS = (
    "mm cm m km in inch inches ft feet foot yd yard yards mi mile miles g kg mg t ton tons lb lbs pound pounds oz ounce ounces "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks "
    "month months year years percent c f k degrees usd eur gbp dollar dollars euro euros cent cents v w kw j kj n pa hz mph kmh"
).split()

MARK = r"([\p{Ll}\p{Nd},;:] )(\p{Lu}\p{Ll})"
GLUE = r"(\p{Nd})(\p{L})"
BREAK = r"[^\p{L}\p{M}\p{N}\x01]+"

#: Which words are names: those inside a sentence, any capitalised ones, none.
READINGS = ["inside", "any", "none"]


#: A capital letter at the start of a word, and a point or comma inside a number; what the SQL does not know of is marked apart.
CAPITAL = r"(?=\p{Lu})(?<![\p{L}\p{M}\p{N}\x01])(\p{Lu}\p{Ll})"
POINT = r"[.,](?<=\p{Nd}.)(?=\p{Nd})"
FIRST, MORE = "\x04", "\x05"
KEPT = r"\p{L}\p{M}\p{N}\x01\x04\x05"
#: What is between words, but for single blanks, which can stay.
BETWEEN = rf"(?:[^ {KEPT}]| (?=[^{KEPT}]))[^{KEPT}]*"


def words_of(text: Column) -> Column:
    """The words in one string, with a blank between; names, other capitalised words and later parts of a number are marked."""
    text = F.coalesce(text, F.lit(""))
    text = F.when(text.contains(FIRST) | text.contains(MORE), F.translate(text, FIRST + MORE, "  ")).otherwise(text)
    marked = F.regexp_replace(text, MARK, f"$1{NAME}$2")
    marked = F.regexp_replace(F.regexp_replace(marked, CAPITAL, f"{FIRST}$1"), POINT, f" {MORE}")
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(marked), GLUE, "$1 $2"), BETWEEN, " "))


def forms(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key, w, odd, whole``: the words of each text, and again with 1,200 or 5.50 as one word (``whole``) where it has any such.

    A text is ``odd`` if it has the mark of a name itself.
    """
    t = rows.select(F.col(key).alias("key"), words_of(F.col(text)).alias("w"), F.coalesce(F.col(text).contains(NAME), F.lit(False)).alias("odd"))
    some = F.when(F.col("w").contains(MORE), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    t = t.select("key", "w", "odd", F.explode(some).alias("whole"))
    whole = F.when(F.col("whole"), F.replace("w", F.lit(f" {MORE}"), F.lit(MORE))).otherwise(F.replace("w", F.lit(MORE), F.lit("")))
    return t.select("key", whole.alias("w"), "odd", "whole")


def words_read(words: Column, names: str) -> Column:
    """The words with the names of one reading marked: ``any`` capitalised word, those ``inside`` a sentence, or ``none``."""
    return {"any": F.translate(words, FIRST, NAME), "inside": F.replace(words, F.lit(FIRST), F.lit("")), "none": F.translate(words, NAME + FIRST, "")}[names]


def numbered(words: Column) -> Column:
    """The words with numbers as placeholders."""
    return F.regexp_replace(words, rf"(?=\p{{Nd}})(?<![^ ])\p{{Nd}}[\p{{Nd}}{MORE}]*(?![^ ])", NUMBER)


def with_units(words: Column) -> Column:
    """``numbered`` words with units as placeholders."""
    return F.regexp_replace(words, f"{NUMBER} (?:{'|'.join(UNITS)})(?![^ ])", f"{NUMBER} {UNIT}")


def template_of(words: Column, names: str) -> Column:
    """``numbered`` words with all placeholders, one to one."""
    out = with_units(words_read(words, names))
    return out if names == "none" else F.regexp_replace(out, f"{NAME}[^ ]*", NAME)


def with_templates(rows: DataFrame) -> DataFrame:
    """``forms`` with ``template_of`` of each reading, as strings; what the readings share is made once."""
    t = rows.withColumn("numbered", numbered(F.col("w")))
    t = t.withColumn("united", F.when(F.col("numbered").contains(NUMBER), with_units(F.col("numbered"))).otherwise(F.col("numbered")))
    t = t.withColumn("named", F.when(F.col("united").contains(NAME), F.regexp_replace("united", f"{NAME}[^ ]*", NAME)).otherwise(F.col("united")))
    # a marked word is a unit in the readings that don't have the mark
    again = lambda out, *marks: F.when(reduce(or_, (F.col("united").contains(f"{NUMBER} {m}") for m in marks)), with_units(out)).otherwise(out)
    t = t.select(
        "*", F.replace("named", F.lit(FIRST), F.lit("")).alias("inside"), F.translate("united", NAME + FIRST, "").alias("none"),
        F.when(F.col("named").contains(FIRST), F.regexp_replace("named", f"{FIRST}[^ ]*", NAME)).otherwise(F.col("named")).alias("any"),
    )
    none = F.when(F.col("odd"), template_of(numbered(words_read(F.col("w"), "none")), "none")).otherwise(again(F.col("none"), NAME, FIRST))
    return t.select("key", "w", "whole", again(F.col("inside"), FIRST).alias("inside"), "any", none.alias("none"))


def anchor(n: int, t: Column, i: Column) -> Column:
    """A hash of three words of the window at ``i``: what has none of the benchmark's anchors is none of its windows."""
    return F.xxhash64(F.lit(n), F.get(t, i), F.get(t, i + n // 2), F.get(t, i + (n - 1)))


def windows(rows: DataFrame, lengths: list[int], plain: list[str], least: int, bits: list[int] | None = None, whole_below: int = 0) -> DataFrame:
    """``key, pos, n, hash, anchor, slots, plain`` of all windows of ``forms``, or of those whose anchor and hash are in ``bits``.

    A reading adds its windows where they differ from the last one's; lengths
    under ``whole_below`` are for texts of that length.  Places are those of the
    words with 1,200 as two.  A window is plain if the readings ``plain``, of which
    ``inside`` is one, show it in words with 1,200 as two.
    """
    #: What tells a reading from the first; without that it has no templates.
    telling = {"inside": None, "any": FIRST, "none": NAME}
    given = {r: F.split(r, " ") for r in READINGS}
    told = {r: F.when(F.col("w").contains(telling[r]), given[r]) if telling[r] else given[r] for r in READINGS}
    t = with_templates(rows).select("key", "whole", F.split("w", " ").alias("w"), *(told[r].alias(f"t_{r}") for r in READINGS))
    held = F.from_json(F.lit(str(bits)), "array<bigint>") if bits else None  # folded to one literal
    size = F.size("t_inside")

    def known(a: Column) -> Column:
        word = F.get(held, F.shiftrightunsigned(a, 6).bitwiseAND(F.lit(len(bits) - 1)).cast("int"))
        return F.getbit(word, a.bitwiseAND(F.lit(63)).cast("int")) == 1

    def before(i: Column) -> Column:
        own = F.array_join(F.slice("w", 1, i), "")
        return F.when(F.col("whole"), i + F.length(own) - F.length(F.replace(own, F.lit(MORE), F.lit("")))).otherwise(i)

    def slots(r: str, w: Column, own: Column) -> Column:
        pairs = F.zip_with(w, own, lambda w, x: F.when(words_read(w, r) != x, words_read(w, r)))
        return F.filter(pairs, lambda x: x.isNotNull())

    def few(n: int, own: Column) -> Column:
        return F.size(reduce(F.array_remove, (NAME, NUMBER, UNIT), own)) < (n + 1) // 2

    def hashed(r: str, n: int, w: Column, own: Column) -> Column:
        if n < least:
            return F.xxhash64(own, slots(r, w, own))
        return F.xxhash64(own, F.when(few(n, own), slots(r, w, own)))  # mostly slots: only equal values will do

    def can_be_held(n: int, own: Column) -> Column:
        """As far as it can be told without the slots."""
        return F.lit(True) if n < least else few(n, own) | known(F.xxhash64(own, F.lit(None).cast("array<string>")))

    def one(r: str, n: int, pos: Column, w: Column, own: Column, first: Column) -> Column:
        """A window of the words ``w``, which are ``own`` in this reading and ``first`` in the first one."""
        return F.struct(
            pos.alias("pos"), F.lit(n).alias("n"), hashed(r, n, w, own).alias("hash"), anchor(n, own, F.lit(0)).alias("anchor"),
            slots(r, w, own).alias("slots"), (~F.col("whole") & (F.lit(True) if r in plain else own == first)).alias("plain"),
        )

    if bits:
        # a row for each place and, behind it, one for each length and reading: generated code, as lambdas over arrays are not, and one copy of the bits
        # (outer: else Spark puts a filter on the array's size below, which makes all templates a second time; it never is empty)
        kinds, i = [(n, r) for n in lengths for r in READINGS], F.col("i")
        of_kind = lambda given: reduce(lambda rest, k: F.when(F.col("kind") == k, given[k]).otherwise(rest), range(len(kinds) - 1), given[-1])
        ways = F.array(*(F.when((i <= size - n) & F.col(f"t_{r}").isNotNull(), anchor(n, F.col(f"t_{r}"), i)) for n, r in kinds))
        t = t.select("*", F.posexplode_outer("t_inside").alias("i", "word")).select("key", "whole", "w", *(f"t_{r}" for r in READINGS), "i", F.posexplode(ways).alias("kind", "known"))
        cut = lambda c, n: F.slice(c, i + 1, n)  # noqa: E731  not the whole text's words for each window
        first, w = (of_kind([cut(c, n) for n, _ in kinds]) for c in ("t_inside", "w"))
        own = of_kind([cut(f"t_{r}", n) for n, r in kinds])
        t = t.filter(known(F.col("known"))).select("key", "whole", "kind", before(i).alias("pos"), w.alias("w"), own.alias("own"), first.alias("first"))
        t = t.filter(of_kind([can_be_held(n, F.col("own")) for n, _ in kinds]))
        found = of_kind([one(r, n, *map(F.col, ("pos", "w", "own", "first"))) for n, r in kinds])
        return t.select("key", F.explode(F.array(found)).alias("found")).filter(known(F.col("found.hash"))).select("key", "found.*")

    def every(n: int) -> Column:
        def at(r: str, i: Column) -> Column:
            return one(r, n, before(i), *(F.slice(c, i + 1, n) for c in ("w", f"t_{r}", "t_inside")))

        def differs(r: str, others: list[str], i: Column) -> Column:
            own = F.slice(f"t_{r}", i + 1, n)
            return reduce(and_, (F.coalesce(own != F.slice(f"t_{o}", i + 1, n), F.lit(True)) for o in others))

        parts = []
        for k, r in enumerate(READINGS):
            places = F.sequence(F.lit(0), F.greatest(size - n, F.lit(0)))
            own = F.filter(places, partial(differs, r, READINGS[:k])) if k else places
            parts.append(F.when(F.col(f"t_{r}").isNotNull(), F.transform(own, partial(at, r))).otherwise(F.array()))
        return F.when(size == n if n < whole_below else size >= n, F.concat(*parts)).otherwise(F.array())

    # one pass, whatever the number of lengths
    return t.select("key", F.inline(F.concat(*map(every, lengths)) if len(lengths) > 1 else every(lengths[0])))


def benchmark_windows(bench: DataFrame, words: int = WORDS, least: int = LEAST) -> tuple[DataFrame, list[int]]:
    """Windows of the benchmark that are specific enough, written once, and their lengths."""
    sized = forms(bench, "item_id", "text")
    n = F.size(F.split("w", " "))
    lengths = [*sorted(r[0] for r in sized.select("w", n.alias("n")).filter((F.col("w") != "") & (F.col("n") < words)).select("n").distinct().collect()), words]
    parts = windows(sized.filter(F.col("w") != ""), lengths, ["inside", "none"], least, whole_below=words)
    found = parts.filter(F.col("n") > F.size("slots")).groupBy("key", "pos", "n", "hash", "anchor", "slots").agg(F.max("plain").alias("item_plain"))
    return materialise(found.withColumnsRenamed({"key": "item_id", "pos": "item_pos", "slots": "item_slots"}), "benchmark"), lengths


def anchor_bits(of_bench: DataFrame, count: int) -> list[int]:
    """A bitmap of the benchmark's anchors and hashes, in signed words of 64 bits: 64 bits a window, up to 2 MB in all."""
    words = min(1 << 18, max(64, 1 << (count - 1).bit_length()))
    at = F.shiftrightunsigned("x", 6).bitwiseAND(F.lit(words - 1))
    bit = F.expr("shiftleft(1L, cast(x & 63 AS int))")
    bits = [0] * words
    for r in of_bench.select(F.explode(F.array("anchor", "hash")).alias("x")).select(at.alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).collect():
        bits[r["at"]] = r["bits"]
    return bits


def consistent(a: Column, b: Column) -> Column:
    """Equal values stay equal, different ones different."""
    a, b = F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))
    pairs = F.size(F.array_distinct(F.arrays_zip(a.alias("a"), b.alias("b"))))
    return (F.size(a) == F.size(b)) & (pairs == F.size(F.array_distinct(a))) & (pairs == F.size(F.array_distinct(b)))


def matches(docs: DataFrame, bench: DataFrame, words: int = WORDS, least: int = LEAST) -> DataFrame:
    """``doc_id, item_id, n_windows, n_exact, first_word`` of each document and item that share consistent windows.

    ``plain_windows, plain_exact, plain_first`` are the same of the plain windows: 0, 0 and null where only other readings show any.
    """
    of_bench, lengths = benchmark_windows(bench, words, least)
    size = of_bench.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(F.array_join("item_slots", " "))), F.lit(0)).alias("bytes")).first()
    count = size["n"]
    small = 0 < count <= BROADCAST_WINDOWS and size["bytes"] <= BROADCAST_BYTES
    side = F.broadcast(of_bench.drop("anchor")) if small else of_bench.drop("anchor")
    bits = anchor_bits(of_bench, count) if small else None
    empty = F.array().cast("array<string>")
    of_docs = windows(forms(docs, "doc_id", "text"), lengths, ["inside"], least, bits)
    hits = of_docs.join(side, ["n", "hash"]).filter(consistent(F.col("item_slots"), F.col("slots")))
    same, plain = F.coalesce("slots", empty) == F.coalesce("item_slots", empty), F.col("plain") & F.col("item_plain")
    return (
        hits.groupBy(F.col("key").alias("doc_id"), "item_id", "pos")
        .agg(F.max(same).alias("same"), F.max(plain).alias("plain"), F.max(plain & same).alias("plain_same"))
        .groupBy("doc_id", "item_id")
        .agg(
            F.count(F.lit(1)).alias("n_windows"), F.count_if("same").alias("n_exact"), F.min("pos").cast("long").alias("first_word"),
            F.count_if("plain").alias("plain_windows"), F.count_if("plain_same").alias("plain_exact"),
            F.min(F.when(F.col("plain"), F.col("pos"))).cast("long").alias("plain_first"),
        )
    )


def decontaminate(docs: DataFrame, bench: DataFrame, words: int = WORDS, least: int = LEAST) -> DataFrame:
    """The documents (all their columns) that share no consistent window with any item."""
    leaked = lambda rows: materialise(matches(rows, bench, words, least).select(F.col("doc_id").alias("id")).distinct(), "leaked")
    kept = select_by_id(docs.filter("doc_id IS NOT NULL"), leaked(docs.filter("doc_id IS NOT NULL")), "left_anti")
    nameless = docs.filter("doc_id IS NULL")
    if nameless.isEmpty():
        return kept
    own = F.sha2(F.coalesce("text", F.lit("")), 256)
    gone = leaked(nameless.select(own.alias("doc_id"), "text"))
    return kept.unionByName(nameless.join(gone.withColumnRenamed("id", "leaked text"), own == F.col("leaked text"), "left_anti"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL's rows, from those of all readings: the plain windows (names inside a sentence only, each part of a number a word)."""
    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).filter("plain_windows > 0")
    return found.select(
        "doc_id", "item_id", F.col("plain_windows").alias("n_windows"), F.col("plain_exact").alias("n_exact"), F.col("plain_first").alias("first_word")
    )


def oracle(documents: str = "documents") -> str:
    units = ", ".join(f"'{u}'" for u in UNITS)

    def words(rel: str, key: str, mark: bool = True) -> str:
        marked = r"lower(regexp_replace(coalesce(text, ''), '%s', '\1' || chr(1) || '\2', 'g'))" % MARK
        marked = marked if mark else "lower(coalesce(text, ''))"
        glued = rf"regexp_replace({marked}, '{GLUE}', '\1 \2', 'g')"
        split = rf"string_split(trim(regexp_replace({glued}, '{BREAK}', ' ', 'g')), ' ')"
        return f"SELECT {key} AS key, {split} AS w FROM {rel}"

    number = r"regexp_full_match({}, '\p{{Nd}}+')".format
    return f"""
WITH all_words AS (
  SELECT 'd' AS side, * FROM ({words(documents, 'doc_id')}) UNION ALL SELECT 'b', * FROM ({words('benchmark', 'item_id')})
  UNION ALL SELECT 'b', * FROM ({words('benchmark', 'item_id', False)})
), templates AS (
  SELECT side, key, w, list_transform(range(1, len(w) + 1), lambda i: CASE
    WHEN starts_with(w[i], chr(1)) THEN chr(1) WHEN {number('w[i]')} THEN chr(2)
    WHEN i > 1 AND {number('w[i - 1]')} AND w[i] IN ({units}) THEN chr(3) ELSE w[i] END) AS t FROM all_words
), lens AS (
  SELECT {WORDS} AS n UNION SELECT len(t) FROM templates WHERE side = 'b' AND len(t) BETWEEN 1 AND {WORDS - 1} AND w <> ['']
), wins AS (
  SELECT side, key, p, n, list_slice(t, p + 1, p + n) AS t, list_slice(w, p + 1, p + n) AS w FROM (
    SELECT *, unnest(range(len(t) - n + 1)) AS p FROM templates, lens
    WHERE len(t) >= n AND (side = 'd' OR n = {WORDS} OR len(t) = n))
), slotted AS (
  SELECT *, list_filter(list_transform(range(1, n + 1), lambda i: CASE WHEN w[i] <> t[i] THEN w[i] END), lambda x: x IS NOT NULL) AS s FROM wins
), hits AS (
  SELECT d.key AS doc_id, b.key AS item_id, d.p, bool_or(d.s = b.s) AS same FROM slotted d JOIN slotted b
    ON d.side = 'd' AND b.side = 'b' AND d.n = b.n AND d.t = b.t AND b.n > len(b.s) AND (d.s = b.s OR (b.n >= {LEAST} AND b.n - len(b.s) >= ceil(b.n / 2)))
  WHERE len(list_distinct(list_zip(b.s, d.s))) = len(list_distinct(b.s)) AND len(list_distinct(b.s)) = len(list_distinct(d.s))
  GROUP BY ALL
)
SELECT doc_id, item_id, count(*) AS n_windows, count(*) FILTER (same) AS n_exact, min(p)::BIGINT AS first_word
FROM hits GROUP BY ALL
"""


ORACLE_SQL = oracle()
