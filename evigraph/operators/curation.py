"""Human curation as an overlay over raw data that is never changed.

Events are rows (event_id, created_at, paper_id, event_type, entity_type, entity_uid, new), replayed in the order
(created_at, event_id). Edits of an entity apply field by field, the last value of each field holds; a deletion is final,
whatever comes after it; added entities come in event order and may be edited and deleted like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import surface_key
from ..functions.text import collapse


def last_patch(events: DataFrame, keys: list[str], order: list[str], fields: dict[str, Column], deleted: Column) -> DataFrame:
    """One row a key: the last value of each field among the events that set it (not null), and whether one deletes.

    Everything is a commutative aggregate, so events pre-aggregate before they are moved and hot entities are no task.
    """
    at = F.struct(*order)
    last = [F.max_by(v, F.when(v.isNotNull(), at)).alias(k) for k, v in fields.items()]
    return events.groupBy(*keys).agg(*last, F.max(deleted).alias("deleted"), F.count("*").alias("n_events"))


def overlay(base: DataFrame, patches: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """``base`` with the patched fields, deleted entities left out, and the raw values kept as <field>_original."""
    p = patches.select(*keys, *[F.col(f).alias(f"__{f}") for f in fields], "deleted")
    out = base.join(p, keys, "left").where(~F.coalesce("deleted", F.lit(False)))
    return out.select(*[F.coalesce(f"__{c}", c).alias(c) if c in fields else F.col(c) for c in base.columns], *[F.col(f).alias(f"{f}_original") for f in fields])


def alias_map(terms: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """(term_type, key, canonical): canonical and alias spellings by surface key; a later alias wins, decisions of people
    (term_alias events with alias and canonical) override the list."""
    listed = terms.select("term_type", "canonical", F.posexplode(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("pos", "alias"), F.lit(0).alias("human"), F.lit(None).cast("timestamp_ntz").alias("at"), F.lit("").alias("event_id"))
    rows = listed.select("term_type", "canonical", "alias", "human", "at", "event_id", "pos")
    if events is not None:
        e = events.where("event_type = 'term_alias'").select(F.col("entity_type").alias("term_type"), F.col("new.canonical").alias("canonical"), F.explode(F.array("new.alias", "new.canonical")).alias("alias"), F.lit(1).alias("human"), F.col("created_at").cast("timestamp_ntz").alias("at"), "event_id", F.lit(0).alias("pos"))
        rows = rows.unionByName(e)
    keyed = rows.withColumn("key", surface_key("alias")).where("key != '' and canonical is not null")
    return keyed.groupBy("term_type", "key").agg(F.max_by("canonical", F.struct("human", "at", "event_id", "canonical")).alias("canonical"))


def resolve(values: DataFrame, aliases: DataFrame, term_type: str, value: str) -> DataFrame:
    """``values`` with canonical and canonical_source: alias, passthrough or empty."""
    shown = collapse(F.col(value))
    keyed = values.withColumn("key", surface_key(shown))
    hit = aliases.where(F.col("term_type") == term_type).select("key", F.col("canonical").alias("hit"))
    out = keyed.join(hit, "key", "left")
    return out.select(*values.columns, F.coalesce("hit", shown).alias("canonical"), F.when(F.col("key") == "", "empty").when(F.col("hit").isNotNull(), "alias").otherwise("passthrough").alias("canonical_source"))


def apply_terms(items: DataFrame, events: DataFrame, aliases: DataFrame, kind: str, key=surface_key) -> DataFrame:
    """Terms of papers after all decisions about them: items (paper_id, uid, raw, norm) with canonical and canonical_source.

    ``events`` (event_id, created_at, paper_id, event_type, uid, canonical, value) are of one ``kind`` of term. An override
    holds over the alias list, the last one if several; a deletion is final; a term added by an event has the uid
    ``kind:user:event_id`` and may be overridden and deleted like others. Added terms with a blank value are left out.
    ``aliases`` has (key, canonical); ``key`` makes the key of a value. Raw values are never changed.
    """
    said = collapse(F.col("canonical"))
    override = F.when((F.col("event_type") == "term_override") & (said != ""), said)
    at = F.struct("created_at", "event_id")
    patches = events.where("event_type in ('term_override', 'term_delete')").groupBy("paper_id", "uid").agg(F.max_by(override, F.when(override.isNotNull(), at)).alias("override"), F.max(F.col("event_type") == "term_delete").alias("gone"))
    base = items.select("paper_id", "uid", "raw", F.coalesce(F.nullif(collapse(F.col("norm")), F.lit("")), collapse(F.col("raw"))).alias("shown"), F.lit(False).alias("user"))
    value = collapse(F.col("value"))
    added = events.where("event_type = 'term_add'").select("paper_id", F.concat(F.lit(f"{kind}:user:"), F.col("event_id").cast("string")).alias("uid"), value.alias("raw"), value.alias("shown"), F.lit(True).alias("user")).where("raw != ''").distinct()
    rows = base.unionByName(added).withColumn("key", key(F.col("shown")))
    hit = rows.join(aliases.where("key != ''").select("key", F.col("canonical").alias("hit")), "key", "left").join(patches, ["paper_id", "uid"], "left").where(~F.coalesce("gone", F.lit(False)))
    source = F.when(F.col("override").isNotNull(), "paper_override").when(F.col("user"), "user_added").when(F.col("key") == "", "empty").when(F.col("hit").isNotNull(), "alias").otherwise("passthrough")
    return hit.select("paper_id", "uid", "raw", F.coalesce("override", "hit", "shown").alias("canonical"), source.alias("canonical_source"))


#: Fields that an edit of a claim may set.
CLAIM_FIELDS = ("statement", "claim_type", "subject", "relation", "object", "conditions_text", "review_status", "review_notes")


def apply_claims(claims: DataFrame, events: DataFrame) -> DataFrame:
    """Claims (paper_id, uid and CLAIM_FIELDS) after their events (event_id, created_at, paper_id, event_type, uid, patch map of the
    fields set, null values included): edits apply field by field, a deletion is final, claim_add appends claims with a
    statement under the uid ``claim:user:event_id``, which later events may edit and delete. Raw values as <field>_original."""
    new = events.where("event_type = 'claim_add'").select("paper_id", F.concat(F.lit("claim:user:"), F.col("event_id").cast("string")).alias("uid"), F.lit("user_added").alias("curation_origin"), *[(collapse(F.col("patch")["statement"]) if f == "statement" else F.coalesce(F.col("patch")[f], F.lit({"claim_type": "user_curated", "review_status": "edited"}.get(f)).cast("string"))).alias(f) for f in CLAIM_FIELDS]).where("statement != ''")
    rows = claims.select("paper_id", "uid", F.lit(None).cast("string").alias("curation_origin"), *CLAIM_FIELDS).unionByName(new)
    at = F.struct("created_at", "event_id")
    edit = lambda f: (F.col("event_type") == "claim_edit") & F.map_contains_key("patch", F.lit(f))
    last = [F.max(F.when(edit(f), F.struct(at.alias("at"), F.col("patch")[f].alias("v")))).alias(f"e_{f}") for f in CLAIM_FIELDS]
    patches = events.where("event_type in ('claim_edit', 'claim_delete')").groupBy("paper_id", "uid").agg(*last, F.max(F.col("event_type") == "claim_delete").alias("gone"), F.max(F.col("event_type") == "claim_edit").alias("edited"))
    out = rows.join(patches, ["paper_id", "uid"], "left").where(~F.coalesce("gone", F.lit(False)))
    kept = [F.when(F.col(f"e_{f}").isNotNull(), F.col(f"e_{f}.v")).otherwise(F.col(f)).alias(f) for f in CLAIM_FIELDS]
    return out.select("paper_id", "uid", *kept, *[F.col(f).alias(f"{f}_original") for f in CLAIM_FIELDS], F.when(F.coalesce("edited", F.lit(False)), "user_edited").otherwise(F.col("curation_origin")).alias("curation_origin"))
