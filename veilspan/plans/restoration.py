"""The vault and restoration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.operators import redact, restore, vault
from veilspan.operators.detect import explode_spans
from veilspan.plans import common
from veilspan.plans.catalog import Catalog
from veilspan.plans.oracle_parts import (SRC_FORMS, first_token, q, restored_ctes, spliced_cte,
                                         with_)
from veilspan.plans.redaction import KEYED_TEXT, ORDINAL, ORDINAL_TEXT, ordinal, ordinal_redacted
from veilspan.plans.sources import VAULT_CTES
from veilspan.sources import vault_table

# Reply texts derived from the redacted forms: the text, then a possessive use
# of the first word of its second line's name.
REPLY_TAIL = "'s papers are complete."
KEYED_VAULT_COLS = "session_id, pii_type, real, synthetic"


def as_vault(mappings: DataFrame, session: str = "session_id") -> DataFrame:
    return mappings.select(F.col(session).cast("string").alias("session_id"), "pii_type", "real",
                           "synthetic", F.lit("2024-01-01").cast("timestamp").alias("first_seen_ts"))


def session_ordinals(spark: SparkSession, d: str) -> DataFrame:
    """Ordinal mappings of all forms; they are seen in the order of form and mapping."""
    sessions = common.forms(spark, d).select("doc_id", "session_id")
    return ordinal(spark, d).join(sessions, "doc_id").withColumn(
        "first_seen_ts", F.lit("2024-01-01").cast("timestamp"))


def first_wins(spark: SparkSession, d: str) -> DataFrame:
    """Insert if absent by real value: the first synthetic value of a session stays."""
    empty = common.keyed_vault(spark, d).filter("false")
    out = vault.vault_upsert(empty, session_ordinals(spark, d), vault.BY_REAL, injective=False,
                             order=("doc_id", "ord"))
    return out.select("session_id", "pii_type", "real", "synthetic")


def unknown_mappings(spark: SparkSession, d: str) -> DataFrame:
    """Mappings of all forms that a vault of the SSNs and names does not have yet."""
    known = common.keyed_vault(spark, d)
    part = known.filter(F.col("pii_type").isin("SSN", "PERSON_NAME"))
    return vault.new_mappings(part, known).select("session_id", "pii_type", "real", "synthetic")


def injective_vault(spark: SparkSession, d: str, session=None) -> DataFrame:
    """All keyed mappings, collisions renamed, written to the table and read back.

    With ``session`` all forms share that one session, so that values do collide.
    """
    found = redact_spans(spark, d)
    if session:
        found = found.withColumn("session_id", F.lit(session))
    empty = spark.createDataFrame([], vault.VAULT_SCHEMA)
    path = common.fresh_dir(spark, "vault")
    vault_table.write_vault(
        vault.vault_upsert(empty, as_vault(redact.assign_synthetic(found, salt=common.QUERY_SALT))), path)
    return vault_table.read_vault(spark, path)


def second_upsert(spark: SparkSession, d: str) -> DataFrame:
    """All mappings added to a table that has those of the forms without a bonus.

    One session, so some values are known, some new, and some new ones collide with known ones. Both
    upserts need the forms' spans, so these are found once and written as a table.
    """
    texts = common.forms(spark, d).withColumn("session_id", F.lit("one")).withColumn(
        "is_first", F.contains("text", F.lit("Bonus: none")))
    found = common.fresh_dir(spark, "spans")
    explode_spans(common.resolved(texts), ("doc_id", "session_id", "is_first")).write.parquet(found)
    texts_spans = spark.read.parquet(found)
    path = common.fresh_dir(spark, "vault")
    for part in (texts_spans.filter("is_first"), texts_spans):
        vault_table.upsert(as_vault(redact.assign_synthetic(part, salt=common.QUERY_SALT)), path)
    return vault_table.read_vault(spark, path).select("pii_type", "real", "synthetic")


def redact_spans(spark: SparkSession, d: str) -> DataFrame:
    from veilspan.plans.redaction import spans
    return spans(spark, d)


def renamed_values(spark: SparkSession, d: str) -> DataFrame:
    return injective_vault(spark, d, "one").select("pii_type", "real", "synthetic")


def reply_to(redacted: DataFrame) -> DataFrame:
    """A reply that repeats the text and mentions a synthetic first word's possessive."""
    word = F.regexp_extract("sanitized", r": ([A-Z][a-z]+) ", 1)
    return redacted.withColumn("response", F.concat(
        "sanitized", F.lit("\n"), word, F.lit(REPLY_TAIL)))


REPLY_SQL = ("replies as (select doc_id, text, sanitized || chr(10) || regexp_extract(sanitized, "
             "': ([A-Z][a-z]+) ', 1) || '''s papers are complete.' as response from sanitized)")


def ordinal_restored(spark: SparkSession, d: str) -> DataFrame:
    texts = reply_to(ordinal_redacted(spark, d))
    return restore.restore(texts, ordinal(spark, d)).select("doc_id", "restored")


def keyed_replies(spark: SparkSession, d: str) -> DataFrame:
    return reply_to(redact.with_mappings(common.redacted(common.forms(spark, d))))


def keyed_chain(spark: SparkSession, d: str) -> DataFrame:
    return restore.restore(keyed_replies(spark, d)).select("doc_id", "restored")


def keyed_rows(spark: SparkSession, d: str) -> DataFrame:
    return restore.restore_keyed_rows(keyed_replies(spark, d)).select("doc_id", "restored")


def keyed_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Forms redacted from the vault, and replies to them restored from it, per session."""
    table = injective_vault(spark, d)
    redacted = redact.redact(common.forms(spark, d), redact_spans(spark, d), table,
                             on=("session_id", "pii_type"))
    texts = reply_to(redacted).select("doc_id", "session_id", "response")
    return restore.restore_keyed(texts, table).select("doc_id", "restored")


def vault_aware(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Forms of one session, redacted with a vault that has renamed values; and that vault."""
    table = injective_vault(spark, d, "one")
    found = common.resolved(common.forms(spark, d).withColumn("session_id", F.lit("one")))
    return redact.redact_with_vault(found, table, common.QUERY_SALT), table


def vault_aware_redacted(spark: SparkSession, d: str) -> DataFrame:
    return vault_aware(spark, d)[0].select("doc_id", "sanitized")


def vault_aware_round_trip(spark: SparkSession, d: str) -> DataFrame:
    redacted, table = vault_aware(spark, d)
    return restore.restore_keyed(redacted.select("doc_id", "session_id", "sanitized"), table,
                                 text_col="sanitized").select("doc_id", "restored")


def round_trip(spark: SparkSession, d: str) -> DataFrame:
    df = redact.with_mappings(common.redacted(common.forms(spark, d)))
    return restore.round_trip(restore.restore(df, text_col="sanitized"))


def ordinal_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Dates share one synthetic value, so most forms cannot come back unharmed."""
    # Never broadcast: forms made from small rows look smaller than they are.
    forms = common.forms(spark, d).select("doc_id", "text")
    texts = ordinal_redacted(spark, d).join(forms.hint("merge"), "doc_id")
    return restore.round_trip(restore.restore(texts, ordinal(spark, d), text_col="sanitized"))


def stubs(spark: SparkSession, d: str) -> DataFrame:
    """Replies made of each form's first synthetic SSN and e-mail."""
    maps = ordinal(spark, d)
    ssn = vault.first_of_type(maps, "SSN", "XXX-XX-XXXX")
    email = vault.first_of_type(maps, "EMAIL", "nobody@mail.example.org")
    both = ssn.select("doc_id", F.col("synthetic").alias("ssn_synthetic")).join(
        email.select("doc_id", F.col("synthetic").alias("email_synthetic")).hint("merge"), "doc_id")
    return restore.response_stub(both)


def restored_stubs(spark: SparkSession, d: str) -> DataFrame:
    return restore.restore(stubs(spark, d), ordinal(spark, d)).select("doc_id", "restored")


STUB_CTES = [
    *ORDINAL, "firsts as (select doc_id, arg_min(synthetic, ord) filter (pii_type = 'SSN') as ssn, "
    "arg_min(synthetic, ord) filter (pii_type = 'EMAIL') as email from ordinal group by doc_id)",
    "stubs as (select doc_id, 'The SSN we have is ' || coalesce(ssn, 'XXX-XX-XXXX') || "
    "'. Letters go to ' || coalesce(email, 'nobody@mail.example.org') || '. All is settled.' "
    "as response from firsts)"]
INJECTIVE = [
    "ranked as (select *, row_number() over (partition by session_id, synthetic "
    "order by sha256(pii_type || '|' || real)) - 1 as n from vault)",
    "injective as (select session_id, pii_type, real, case when n > 0 then synthetic || '~' || "
    "cast(n as varchar) else synthetic end as synthetic from ranked)"]
KEYED_MAPS = ("maps as (select distinct doc_id, 0 as ord, value as real, synthetic from named)")


def first_of(spark: SparkSession, d: str) -> DataFrame:
    return vault.first_of_type(ordinal(spark, d), "ADDRESS", "none")


def with_their_mappings(spark: SparkSession, d: str) -> DataFrame:
    """Each text beside its mappings, joined from the mapping table."""
    counts = ordinal(spark, d).groupBy("doc_id").agg(
        F.array_join(F.array_sort(F.collect_list("synthetic")), "|").alias("synthetics"))
    return common.forms(spark, d).join(counts, "doc_id", "left").select("doc_id", "synthetics")


def register(c: Catalog) -> None:
    c.add("vault_first_wins", first_wins, with_(
        [*ORDINAL, "seen as (select o.*, s.session_id from ordinal o join src s using (doc_id))"],
        "select session_id, pii_type, real, synthetic from (select *, row_number() over (partition by "
        "session_id, real order by doc_id, ord, pii_type, synthetic) as rn from seen) x "
        "where rn = 1"))
    c.add("vault_unknown_mappings", unknown_mappings, with_(
        VAULT_CTES, "select * from vault where pii_type not in ('SSN', 'PERSON_NAME')"))
    one_session = [cte.replace("select form_id as doc_id, session_id,",
                               "select form_id as doc_id, 'one' as session_id,")
                   if cte.startswith("src as") else cte for cte in VAULT_CTES]
    c.add("vault_without_collisions", renamed_values, with_(
        [*one_session, *INJECTIVE], "select pii_type, real, synthetic from injective"))
    # Those of the first load come first in their group.
    c.add("vault_second_upsert", second_upsert, with_(
        [*one_session, "early as (select distinct r.pii_type, r.value as real from resolved r join src s using "
         "(doc_id) where contains(s.text, 'Bonus: none'))",
         "placed as (select v.*, row_number() over (partition by synthetic order by (e.real is null), "
         "sha256(v.pii_type || '|' || v.real)) - 1 as n from vault v left join early e on e.real = v.real "
         "and e.pii_type = v.pii_type)"],
        "select pii_type, real, synthetic || case when n > 0 then '~' || cast(n as varchar) else '' end "
        "as synthetic from placed"))
    c.add("vault_aware_redacted_forms", vault_aware_redacted, with_(
        [*one_session, *INJECTIVE, "own_named as (select r.*, i.synthetic from resolved r join injective i "
         "on i.real = r.value and i.pii_type = r.pii_type)", spliced_cte("own_named")],
        "select doc_id, sanitized from sanitized"))
    c.add("vault_aware_round_trip", vault_aware_round_trip, with_(
        [SRC_FORMS], "select doc_id, text as restored from src"))
    c.add("vault_collisions", lambda s, d: vault.collisions(as_vault(session_ordinals(s, d))), with_(
        [*ORDINAL, "seen as (select o.*, s.session_id from ordinal o join src s using (doc_id))"],
        "select session_id, synthetic, count(distinct real) as n_reals from seen group by 1, 2 "
        "having count(distinct real) > 1"))
    c.add("audit_trail", lambda s, d: vault.audit_trail(common.keyed_vault(s, d)),
          with_(VAULT_CTES, f"select {KEYED_VAULT_COLS} from vault"))
    c.add("cleared_session", lambda s, d: vault.clear_session(common.keyed_vault(s, d), "3").select(
        "session_id", "pii_type", "real", "synthetic"),
        with_(VAULT_CTES, f"select {KEYED_VAULT_COLS} from vault where session_id <> '3'"))
    c.add("ordinal_restored_replies", ordinal_restored, with_(
        [*ORDINAL_TEXT, REPLY_SQL, *restored_ctes("replies", "ordinal")],
        "select doc_id, restored from restored"))
    keyed = with_([*KEYED_TEXT, REPLY_SQL, KEYED_MAPS, *restored_ctes("replies", "maps")],
                  "select doc_id, restored from restored")
    c.add("keyed_restored_replies", keyed_rows, keyed)
    c.add("keyed_restored_replies_by_chain", keyed_chain, keyed)
    # Every form comes back as it was; the possessive belongs to the session's
    # longest value with that first word.
    c.add("keyed_restored_by_lookup", keyed_lookup, with_(
        [*VAULT_CTES, *INJECTIVE, "named2 as (select r.*, v.synthetic from resolved r join src s "
         "using (doc_id) join injective v on v.session_id = s.session_id and v.pii_type = r.pii_type "
         "and v.real = r.value)", spliced_cte("named2"),
         f"heads as (select session_id, {first_token('synthetic')} as head, arg_min("
         f"{first_token('real')}, (-length(synthetic), synthetic, real)) as owner from injective "
         "group by all)"],
        "select s.doc_id, s.text || chr(10) || h.owner || "
        + q(REPLY_TAIL) + " as restored "
        "from src s join sanitized z using (doc_id) join heads h on h.session_id = s.session_id "
        "and h.head = regexp_extract(z.sanitized, ': ([A-Z][a-z]+) ', 1)"))
    c.add("keyed_round_trip", round_trip, with_(
        [*KEYED_TEXT, KEYED_MAPS, *restored_ctes("sanitized", "maps", "sanitized")],
        "select s.doc_id, (select count(*) from maps m where m.doc_id = s.doc_id) as n_mappings, "
        "(select bool_and(contains(restored, m.real)) from maps m where m.doc_id = s.doc_id) "
        "as has_all_reals, restored = s.text as is_equal from src s join restored r using (doc_id)"))
    c.add("ordinal_round_trip", ordinal_round_trip, with_(
        [*ORDINAL_TEXT, *restored_ctes("sanitized", "ordinal", "sanitized")],
        "select s.doc_id, (select count(*) from ordinal m where m.doc_id = s.doc_id) as n_mappings, "
        "(select bool_and(contains(restored, m.real)) from ordinal m where m.doc_id = s.doc_id) "
        "as has_all_reals, restored = s.text as is_equal from src s join restored r using (doc_id)"))
    c.add("first_mapping_of_type", first_of, with_(
        ORDINAL, "select doc_id, coalesce(arg_min(real, ord) filter (pii_type = 'ADDRESS'), 'none') "
        "as real, coalesce(arg_min(synthetic, ord) filter (pii_type = 'ADDRESS'), 'none') as synthetic "
        "from ordinal group by doc_id"))
    c.add("response_stubs", lambda s, d: stubs(s, d).select("doc_id", "response"),
          with_(STUB_CTES, "select doc_id, response from stubs"))
    c.add("restored_stubs", restored_stubs, with_(
        [*STUB_CTES, *restored_ctes("stubs", "ordinal")], "select doc_id, restored from restored"))
    c.add("texts_with_mappings", with_their_mappings, with_(
        ORDINAL, "select s.doc_id, string_agg(synthetic, '|' order by synthetic) as synthetics "
        "from src s left join ordinal o using (doc_id) group by s.doc_id"))
