"""Document fingerprints by one-permutation MinHash (DataFrame functions only).

The shingles of a text (runs of five words) are hashed once, to 60 bits: the top bits choose one of 256 bins,
each bin keeps its smallest hash.  An empty bin takes the value of a bin that is not empty (optimal
densification): it tries bins in an order that depends on the empty bin alone, by 2-universal hashes, and
ranks all others by one more such hash if those are empty too.  Of each bin the four low bits are packed, 16
bins to a long; the share of equal bins is corrected for those that agree by chance, 1 in 16.

A document's neighbour in the order of ids is found over narrow rows (keys, positions); only the head of each
text that its predecessor needs is shuffled beside the texts themselves.

Defined cases: a null text is an empty text; words are runs of anything but \\x20 and \\x09-\\x0D, A-Z
lower-cased; with fewer than five words the whole sequence is one shingle; a text without words has the empty
fingerprint, whose likeness is 1.0 to another such and 0.0 to any other; a null id comes first; rows with the
same id are ordered by a hash of their text; rows equal in id and text are neighbours, and are taken
as one row with a count until the end; the only row of a table is its own neighbour; an empty table gives an
empty result; columns other than id and text are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table, text_of
from .places import placed

WORDS = 5
BINS, BITS = 256, 4
#: Hashes have 60 bits, 8 of them for the bin.
_REST = 52
_MASK = (1 << _REST) - 1
_SPACE = r"[\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Multipliers of the 2-universal hashes: a Lehmer sequence modulo the prime.
PRIME, ROOT = 2147483647, 48271
TRIES = 8
PROBES = [(pow(ROOT, 2 * k + 1, PRIME), pow(ROOT, 2 * k + 2, PRIME)) for k in range(TRIES)]


def _let(value: Column, then) -> Column:
    """then(value), where value is computed once however often ``then`` uses it."""
    return F.transform(F.array(value), then)[0]


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, _UPPER, _UPPER.lower()), _SPACE), "")


def shingle_hash(shingle: Column) -> Column:
    return F.conv(F.substring(F.md5(shingle.cast("binary")), 1, 15), 16, 10).cast("long")


def shingle_hashes(text: Column, k: int = WORDS) -> Column:
    def of(words: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: shingle_hash(F.concat_ws(" ", F.slice(words, i, k))))
        none = F.array().cast("array<bigint>")
        return F.when(F.size(words) == 0, none).when(F.size(words) < k, F.array(shingle_hash(F.concat_ws(" ", words)))).otherwise(runs)

    return _let(word_list(text), of)


def binned(hashes: Column) -> Column:
    """The smallest hash of every bin, in order of bins; an empty bin has all low bits set."""
    highest = F.array(*(F.lit((b << _REST) | _MASK) for b in range(BINS)))
    first = lambda s: F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, _REST) != F.shiftright(F.get(s, i - 1), _REST)))
    return _let(F.sort_array(F.concat(hashes, highest)), first)


def _full(v: Column) -> Column:
    return F.when(v.bitwiseAND(F.lit(_MASK)) != _MASK, v)


def densified(bins: Column) -> Column:
    """bins with each empty one filled; at least one must not be empty."""
    every = F.sequence(F.lit(0), F.lit(BINS - 1))

    def fill(s: Column) -> Column:
        def from_donors(donors: Column) -> Column:
            def of(i: Column) -> Column:
                at = i.cast("long")
                tried = [_full(F.get(s, ((at * a + c) % PRIME % BINS).cast("int"))) for a, c in PROBES]
                rank = lambda j: ((at + 1) * ROOT % PRIME * (j + 1) + at) % PRIME
                best = F.array_min(F.transform(donors, lambda j: F.struct(rank(j).alias("r"), j.alias("j"))))["j"]
                return F.coalesce(_full(F.get(s, i)), *tried, F.get(s, best))

            return F.transform(every, of)

        return _let(F.filter(every, lambda j: _full(F.get(s, j)).isNotNull()), from_donors)

    return _let(bins, fill)


def packed(bins: Column) -> Column:
    """The low bits of 256 bins as 16 longs."""
    some = 64 // BITS
    word = lambda g: F.aggregate(F.slice(bins, g * some + 1, some), F.lit(0).cast("long"), lambda acc, v: F.shiftleft(acc, BITS).bitwiseOR(v.bitwiseAND(F.lit((1 << BITS) - 1))))
    return F.transform(F.sequence(F.lit(0), F.lit(BINS // some - 1)), word)


def fingerprint(text: Column, k: int = WORDS) -> Column:
    """array<long>: the packed fingerprint of a text, empty where it has no words."""
    return _let(shingle_hashes(text, k), lambda h: F.when(F.size(h) == 0, h).otherwise(_let(densified(binned(h)), packed)))


def digits(print_: Column) -> Column:
    """The packed fingerprint as hex digits, one a bin."""
    return F.array_join(F.transform(print_, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingles behind two packed fingerprints."""
    lows = F.lit(0x1111111111111111)

    def unequal(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        return F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseAND(lows))

    same = (F.lit(BINS) - F.aggregate(F.zip_with(a, b, unequal), F.lit(0), lambda s, x: s + x)) / F.lit(float(BINS))
    chance = 0.5**BITS
    corrected = F.greatest(F.lit(0.0), (same - F.lit(chance)) / F.lit(1 - chance))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.when(F.size(a) == F.size(b), 1.0).otherwise(0.0)).otherwise(corrected)


def edited_and_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: _id, n_chars, edited_sha256, _print, _edited (packed fingerprints), near_edited, near_next.
    The edit replaces the last quarter of the code points by the head of the next document."""
    text = text_of(text_col)
    key = F.sha2(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.lit(":"), text).cast("binary"), 256)
    rows = docs.select(F.col(id_col).alias("_id"), key.alias("_key"), text.alias("_text"))
    narrow = rows.groupBy("_key").agg(F.first("_id").alias("_id"), F.max(F.char_length("_text")).alias("_n"), F.count(F.lit(1)).alias("_times"))
    places = placed(narrow.withColumn("_one", F.lit(0)), "_one", [F.col("_id").asc_nulls_first(), F.col("_key")], "docs-in-order")
    follows = places.select(F.col("_key").alias("_next"), ((F.col("_at") + F.col("_of") - 1) % F.col("_of")).alias("_at"))
    links = places.join(follows, "_at").select("_key", "_next", "_id", "_n", "_times")
    # of equal rows all but the last are followed by their like
    last = links.withColumn("_times", F.lit(1).cast("long"))
    asked = staged(last.unionByName(links.where("_times > 1").withColumns({"_next": F.col("_key"), "_times": F.col("_times") - 1})), "neighbours")
    texts = rows.groupBy("_key").agg(F.first("_text").alias("_text"))
    cut = F.expr("_n div 4").cast("int")
    heads = texts.withColumnRenamed("_key", "_next").join(asked, "_next").select("_key", "_next", "_id", "_n", "_times", F.substr(F.col("_text"), F.lit(1), cut).alias("_head"))
    both = texts.join(heads, "_key").withColumn("_new", F.concat(F.substr(F.col("_text"), F.lit(1), (F.col("_n") - cut).cast("int")), F.col("_head")))
    prints = both.select("_key", "_next", "_id", "_n", "_times", F.sha2(F.col("_new").cast("binary"), 256).alias("edited_sha256"), fingerprint(F.col("_text")).alias("_print"), fingerprint(F.col("_new")).alias("_edited"))
    prints = staged(prints, "fingerprints")
    of_next = prints.select(F.col("_key").alias("_next"), F.col("_print").alias("_theirs")).dropDuplicates(["_next"])
    out = prints.join(of_next, "_next").withColumns({"near_edited": likeness(F.col("_print"), F.col("_edited")), "near_next": likeness(F.col("_print"), F.col("_theirs"))})
    out = out.select("_id", F.col("_n").cast("long").alias("n_chars"), "edited_sha256", "_print", "_edited", "near_edited", "near_next", F.explode(F.sequence(F.lit(1).cast("long"), "_times")).alias("_copy"))
    return out.drop("_copy")


def op11_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, as 256 hex digits, one for the low bits of each bin."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = edited_and_next(docs)
    return rows.select(F.col("_id").alias("doc_id"), "n_chars", "edited_sha256", digits(F.col("_print")).alias("fingerprint"), digits(F.col("_edited")).alias("edited_fingerprint"), "near_edited", "near_next")


_SQL_TRIES = ", ".join(f"(e.b * {a} + {c}) % {PRIME} % {BINS}" for a, c in PROBES)
OP11_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256(coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || coalesce(text, '')) AS k FROM documents),
n AS (SELECT *, row_number() OVER w AS r, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next FROM d WINDOW w AS (ORDER BY doc_id NULLS FIRST, k)),
e AS (SELECT *, length(text) AS n_chars, left(text, length(text) - length(text) // 4) || left(next, length(text) // 4) AS edited FROM n),
texts AS (SELECT r, 0 AS kind, text AS t FROM e UNION ALL SELECT r, 1, edited FROM e),
words AS (SELECT r, kind, list_filter(regexp_split_to_array(translate(t, '{_UPPER}', '{_UPPER.lower()}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM texts),
shingles AS (SELECT r, kind, unnest(CASE WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i : i + {WORDS - 1}], ' ')) END) AS s FROM words WHERE len(w) > 0),
hashes AS (SELECT r, kind, CAST('0x' || left(md5(s), 15) AS BIGINT) AS h FROM shingles),
bins AS (SELECT r, kind, h >> {_REST} AS b, min(h) AS h FROM hashes WHERE h & {_MASK} <> {_MASK} GROUP BY ALL),
has AS (SELECT DISTINCT r, kind FROM bins),
empty AS (SELECT r, kind, b FROM (SELECT * FROM has CROSS JOIN range({BINS}) x(b)) ANTI JOIN bins USING (r, kind, b)),
tries AS (SELECT r, kind, b, unnest([{_SQL_TRIES}]) AS j, unnest(range({TRIES})) AS turn FROM empty e),
filled AS (
  SELECT r, kind, b, h FROM bins
  UNION ALL
  SELECT t.r, t.kind, t.b, arg_min(x.h, t.turn) FROM tries t JOIN bins x ON x.r = t.r AND x.kind = t.kind AND x.b = t.j GROUP BY ALL),
ranked AS (
  SELECT o.r, o.kind, o.b, arg_min(x.h, {{'rank': ((o.b + 1) * {ROOT} % {PRIME} * (x.b + 1) + o.b) % {PRIME}, 'j': x.b}}) AS h
  FROM (SELECT r, kind, b FROM empty ANTI JOIN filled USING (r, kind, b)) o JOIN bins x ON x.r = o.r AND x.kind = o.kind GROUP BY ALL),
prints AS (SELECT r, kind, string_agg(substr('0123456789abcdef', CAST(h & {(1 << BITS) - 1} AS BIGINT) + 1, 1), '' ORDER BY b) AS p FROM (FROM filled UNION ALL FROM ranked) GROUP BY ALL),
own AS (SELECT e.r, e.doc_id, e.n_chars, sha256(e.edited) AS edited_sha256, coalesce(a.p, '') AS p, coalesce(b.p, '') AS q FROM e LEFT JOIN prints a ON a.r = e.r AND a.kind = 0 LEFT JOIN prints b ON b.r = e.r AND b.kind = 1),
pairs AS (SELECT o.*, x.p AS z FROM own o JOIN own x ON x.r = CASE WHEN o.r = (SELECT max(r) FROM own) THEN 1 ELSE o.r + 1 END)
SELECT doc_id, n_chars, edited_sha256, p AS fingerprint, q AS edited_fingerprint,
  CASE WHEN p = '' OR q = '' THEN CASE WHEN p = q THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE greatest(0.0::DOUBLE, (({BINS} - hamming(p, q)) / {BINS}.0::DOUBLE - {0.5**BITS}::DOUBLE) / {1 - 0.5**BITS}::DOUBLE) END AS near_edited,
  CASE WHEN p = '' OR z = '' THEN CASE WHEN p = z THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE greatest(0.0::DOUBLE, (({BINS} - hamming(p, z)) / {BINS}.0::DOUBLE - {0.5**BITS}::DOUBLE) / {1 - 0.5**BITS}::DOUBLE) END AS near_next
FROM pairs
"""
