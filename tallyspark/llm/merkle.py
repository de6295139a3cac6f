"""Merkle manifest of a dataset: one tree per group of rows, one tree over the groups' roots, and proofs
by coordinate look-up.

Build: every row is hashed to a leaf and placed in its group (range partition and offsets); runs of
``fanout`` consecutive nodes are concatenated and hashed, level by level, each level a table of runs
in the shared folder.  Prove: a leaf's coordinates (level, run, slot) follow from its index and the
group size alone; they are exploded, joined with the node table, ordered, concatenated and folded.

The runs near a root are asked for by every leaf below them.  The node table is therefore dealt out by
blocks of fanout^2 leaves: a run of one of the lower two levels lies in one block, a higher one is
copied to every block below it (one copy per fanout^2 leaves and level), so that no look-up key is
asked for more than fanout^2 times, whatever share of the rows a group holds.

Defined cases: a null field hashes as ``-`` and differs from an empty text; a null group is a group of
its own, the first; a null order value comes first; rows equal in group and order value are ordered by
leaf, and repeated rows are leaves of their own; a lone leaf is its group's root, a lone group's root
is the root; the proof of both is empty; an empty table gives no row; texts are hashed whole; columns
that are not named as fields are not looked at, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, id_mod, staged, table
from .places import placed

#: Fixed by the contract: fields of a leaf in order, nodes of a run, hex digits of a digest.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 16
HEX = 64
#: Runs of 1 KB are broadcast up to this number of rows (32 MB), beyond it joins shuffle.
FEW_RUNS = 32_000


def leaf_digest(*fields: Column) -> Column:
    """sha256 of the fields, each ``-`` if null, else its byte count, a colon and its value."""
    said = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*said).cast("binary"), 256)


@dataclass
class Manifest:
    """leaves: _tree, _at, _of, _leaf and the carried columns; runs: _tree, _level, _run, _members (hex digests
    in a row); groups: _tree, _subroot, _at, _of; group_runs: as runs, over the groups; root: hex digest, or None."""

    leaves: DataFrame
    runs: list[DataFrame]
    groups: DataFrame
    group_runs: list[DataFrame]
    root: str | None
    fanout: int


def _grow(nodes: DataFrame, fanout: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Runs of each level of all trees of nodes (_tree, _at, _of, _digest), and (_tree, _digest) of their tops."""
    most = nodes.agg(F.max("_of")).first()[0] or 0
    runs, tops = [], nodes.where("_of = 1").select("_tree", "_digest")
    while most > 1:
        # at most fanout nodes meet in a run
        members = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_digest"))), lambda x: x["_digest"]), "")
        level = nodes.where("_of > 1").groupBy("_tree", F.expr(f"_at div {fanout}").alias("_run"), F.expr(f"(_of + {fanout - 1}) div {fanout}").alias("_of")).agg(members.alias("_members"))
        level = staged(level, f"{name}-{len(runs)}")
        runs.append(level.select("_tree", F.lit(len(runs)).alias("_level"), "_run", "_members"))
        nodes = level.select("_tree", F.col("_run").alias("_at"), "_of", F.sha2(F.col("_members").cast("binary"), 256).alias("_digest"))
        tops = tops.unionByName(nodes.where("_of = 1").select("_tree", "_digest"))
        most = -(-most // fanout)
    return runs, tops


def build(rows: DataFrame, fields=FIELDS, group: str = "source", order: str = "doc_id", carry: dict[str, Column] | None = None, fanout: int = FANOUT) -> Manifest:
    """The manifest of rows; ``carry`` names further columns that the leaves keep."""
    tree = F.coalesce(F.concat(F.lit("s"), F.col(group).cast("string")), F.lit("n"))  # null first, then bytewise
    leaves = rows.select(tree.alias("_tree"), F.col(order).alias("_order"), leaf_digest(*(F.col(f) for f in fields)).alias("_leaf"), *(c.alias(k) for k, c in (carry or {}).items()))
    leaves = placed(leaves, "_tree", [F.col("_order").asc_nulls_first(), F.col("_leaf")], "leaves")
    runs, tops = _grow(leaves.select("_tree", "_at", "_of", F.col("_leaf").alias("_digest")), fanout, "runs")
    groups = tops.select(F.lit(0).alias("_all"), "_tree", F.col("_digest").alias("_subroot"))
    groups = placed(groups, "_all", [F.col("_tree")], "groups").drop("_all")
    group_runs, top = _grow(groups.select(F.lit("").alias("_tree"), "_at", "_of", F.col("_subroot").alias("_digest")), fanout, "group-runs")
    root = top.first()
    return Manifest(leaves, runs, groups, group_runs, root and root["_digest"], fanout)


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _node_table(m: Manifest) -> DataFrame:
    """(_tree, _block, _scope, _level, _run, _slot, _members, _subroot): every run that the leaves of a block ask for.
    _scope 0: inside the group; 1: over the groups, where the slot and the group's root come with the run."""
    width = m.fanout**2
    none = {"_slot": F.lit(None).cast("long"), "_subroot": F.lit(None).cast("string")}
    cols = ["_tree", "_block", "_scope", "_level", "_run", "_slot", "_members", "_subroot"]
    blocks = m.leaves.where(f"_at % {width} = 0").select("_tree", F.expr(f"_at div {width}").alias("_block"), "_of")
    parts = [r.withColumns(none | {"_block": F.expr(f"_run * {m.fanout ** (k + 1)} div {width}"), "_scope": F.lit(0)}).select(cols) for k, r in enumerate(m.runs[:2])]
    if len(m.runs) > 2:
        above = [F.when(F.col("_of") > m.fanout**k, F.struct(F.lit(k).alias("_level"), F.expr(f"_block * {width} div {m.fanout ** (k + 1)}").alias("_run"))) for k in range(2, len(m.runs))]
        asked = blocks.select("_tree", "_block", F.explode(F.array_compact(F.array(*above))).alias("c")).select("_tree", "_block", "c.*")
        parts.append(asked.join(bounded(_all(m.runs[2:]), FEW_RUNS), ["_tree", "_level", "_run"]).withColumns(none | {"_scope": F.lit(0)}).select(cols))
    places = F.array(*(F.struct(F.lit(k).alias("_level"), F.expr(f"_at div {m.fanout ** (k + 1)}").alias("_run"), F.expr(f"_at div {m.fanout ** k} % {m.fanout}").alias("_slot")) for k in range(max(1, len(m.group_runs)))))
    paths = m.groups.select("_tree", "_subroot", F.explode(places).alias("c")).select("_tree", "_subroot", "c.*")
    if m.group_runs:
        paths = paths.join(bounded(_all(m.group_runs).drop("_tree"), FEW_RUNS), ["_level", "_run"])
    else:
        paths = paths.withColumn("_members", F.lit(None).cast("string"))
    paths = staged(paths.withColumns({"_run": F.lit(0).cast("long"), "_scope": F.lit(1)}), "group-paths")
    parts.append(blocks.join(bounded(paths, FEW_RUNS), "_tree").select(cols))
    return _all(parts)


def prove(m: Manifest, claim: str = "_leaf", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per leaf: the carried columns, leaf, subroot, root, proof (sibling digests, from the leaf's run to the root's),
    folded_root (the claimed leaf folded with its proof), verified."""
    width, keep = m.fanout**2, [*dict.fromkeys(["_leaf", claim, *carry])]
    inside = [F.when(F.col("_of") > m.fanout**k, F.struct(F.lit(0).alias("_scope"), F.lit(k).alias("_level"), F.expr(f"_at div {m.fanout ** (k + 1)}").alias("_run"), F.expr(f"_at div {m.fanout ** k} % {m.fanout}").alias("_own"))) for k in range(len(m.runs))]
    over = [F.struct(F.lit(1).alias("_scope"), F.lit(k).alias("_level"), F.lit(0).cast("long").alias("_run"), F.lit(None).cast("long").alias("_own")) for k in range(max(1, len(m.group_runs)))]
    asked = m.leaves.select("_tree", "_at", F.expr(f"_at div {width}").alias("_block"), F.explode(F.array_compact(F.array(*inside, *over))).alias("c"), *keep)
    # a leaf's own columns travel with one of its coordinates
    asked = asked.select("_tree", "_at", "_block", "c.*", *(F.when((F.col("c._scope") == 1) & (F.col("c._level") == 0), F.col(k)).alias(k) for k in keep))
    found = asked.join(_node_table(m), ["_tree", "_block", "_scope", "_level", "_run"], "left")
    step = F.struct("_scope", "_level", F.coalesce("_own", "_slot").alias("_slot"), "_members")
    paths = found.repartition("_tree", "_block").groupBy("_tree", "_block", "_at").agg(
        F.filter(F.array_sort(F.collect_list(step)), lambda s: s["_members"].isNotNull()).alias("_path"),
        F.first("_subroot", ignorenulls=True).alias("subroot"),
        *(F.first(k, ignorenulls=True).alias(k) for k in keep),
    )
    from_ = lambda s: (s["_slot"] * HEX + 1).cast("int")
    proof = F.array_join(F.transform("_path", lambda s: F.overlay(s["_members"], F.lit(""), from_(s), F.lit(HEX))), "")
    folded = F.aggregate("_path", F.col(claim), lambda digest, s: F.sha2(F.overlay(s["_members"], digest, from_(s), F.lit(HEX)).cast("binary"), 256))
    out = paths.select(*carry, F.col("_leaf").alias("leaf"), "subroot", F.lit(m.root).cast("string").alias("root"), proof.alias("proof"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof, held against its text with A-Z lower-cased where 5 divides crc32(doc_id) (a null id counts as '')."""
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = F.translate("text", upper, upper.lower())
    tampered = F.when(id_mod("doc_id", 5) == 0, leaf_digest(*(lowered if f == "text" else F.col(f) for f in FIELDS)))
    m = build(docs, carry={"doc_id": F.col("doc_id"), "_tampered": tampered})
    m.leaves = m.leaves.withColumn("_claim", F.coalesce("_tampered", "_leaf"))
    proofs = prove(m, "_claim", ("doc_id",))
    return proofs.select("doc_id", "leaf", "subroot", "root", F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256"), "folded_root", "verified")


def _sql_field(f: str) -> str:
    return f"coalesce(strlen(CAST({f} AS VARCHAR)) || ':' || {f}, '-')"


OP12_SQL = f"""
WITH RECURSIVE crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
rows AS (SELECT *, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS BIGINT)]))) % 5 = 0 AS tampered FROM documents, crc_table),
hashed AS (SELECT doc_id, source, tampered, coalesce('s' || source, 'n') AS tree, sha256({' || '.join(map(_sql_field, FIELDS))}) AS leaf,
  sha256({' || '.join(_sql_field(f) if f != "text" else _sql_field("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')") for f in FIELDS)}) AS low FROM rows),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM hashed),
nodes AS (
  SELECT 0 AS level, tree, pos, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM leaves
  UNION ALL
  SELECT level + 1, tree, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), max((n + 15) // 16) FROM nodes WHERE n > 1 GROUP BY level, tree, pos // 16),
subroots AS (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, pos, subroot AS digest, n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), max((n + 15) // 16) FROM tops WHERE n > 1 GROUP BY level, pos // 16),
root AS (SELECT digest AS root FROM tops WHERE n = 1),
runs AS (
  SELECT 0 AS scope, level, tree, pos // 16 AS run, string_agg(digest, '' ORDER BY pos) AS members FROM nodes WHERE n > 1 GROUP BY ALL
  UNION ALL
  SELECT 1, level, '', pos // 16, string_agg(digest, '' ORDER BY pos) FROM tops WHERE n > 1 GROUP BY ALL),
asked AS (
  SELECT l.tree, l.pos, r.scope, r.level, r.members, l.pos // (16 ** r.level)::BIGINT % 16 AS slot FROM leaves l JOIN runs r ON r.scope = 0 AND r.tree = l.tree AND r.run = l.pos // (16 ** (r.level + 1))::BIGINT
  UNION ALL
  SELECT l.tree, l.pos, r.scope, r.level, r.members, s.pos // (16 ** r.level)::BIGINT % 16 FROM leaves l JOIN subroots s ON s.tree = l.tree JOIN runs r ON r.scope = 1 AND r.run = s.pos // (16 ** (r.level + 1))::BIGINT),
paths AS (SELECT tree, pos, list({{'l': left(members, slot * 64), 'r': substr(members, slot * 64 + 65)}} ORDER BY scope, level) AS path FROM asked GROUP BY tree, pos),
ready AS (SELECT l.doc_id, l.leaf, s.subroot, root.root, coalesce(p.path, []) AS path, CASE WHEN tampered THEN low ELSE leaf END AS claim FROM leaves l JOIN subroots s ON s.tree = l.tree CROSS JOIN root LEFT JOIN paths p ON p.tree = l.tree AND p.pos = l.pos),
folded AS (SELECT *, list_reduce(list_concat([{{'l': claim, 'r': ''}}], path), lambda a, p: {{'l': sha256(p.l || a.l || p.r), 'r': ''}}).l AS folded_root FROM ready)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda p: p.l || p.r), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""
