"""Registered queries over statutes, requests and statements that are made of the given tables by expressions, in Spark and SQL alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.config import ENUMS, KEYWORDS, LIST_CONCEPTS, PASS1_CONCEPTS, PIPEDA_KEYWORDS
from lexloom.functions.text import percent
from lexloom.operators import extract as ex
from lexloom.operators import store, tagging
from lexloom.operators.chunking import chunk
from lexloom.operators.compiled import validate
from lexloom.operators.validate import ddl, statement_rules
from lexloom.plans.chunk_sql import chunks_sql, listed, quoted
from lexloom.plans.queries import ORACLE_SQL, QUERIES, _documents, _ruled, _VALUE, query, read

# Statutes: sentences become lines, and lines get headings and clauses by the letters that they begin with. No rule matches a line that
# one before it has put in.
_SENTENCE = (r"\. ([A-Z])", ".\n{1}")
_TOP = "^(T[a-gi-z])"
_BLANK = ("^([W-Z])", "\n{1}")
STRUCTURE = {
    "GDPR": [_SENTENCE, ("^([O-S])", "2. Consent may be withdrawn at any time by e-mail. {1}"), ("^([I-N])", "1. The controller shall keep personal data no longer than necessary. {1}"), ("^([C-H])", "Article 12\nConsent of the data subject\n{1}"), (_TOP, "CHAPTER IV\nRights\n{1}"), _BLANK],
    "CCPA": [_SENTENCE, ("^([E-O])", "(a) A business shall disclose personal information on request. {1}"), ("^([A-D])", "Section 1798.105\nRight to delete\n{1}"), _BLANK],
    "PIPEDA": [_SENTENCE, ("^([I-O])", "4.3.1 An organization may retain it. {1}"), ("^([C-H])", "4.3 Consent\nKnowledge and consent of the individual are required.\n{1}"), (_TOP, "Schedule 1\nPrinciples\n{1}"), _BLANK],
    "LGPD": [_SENTENCE, ("^([I-O])", "1. base legal e prazo de conserva. {1}"), ("^([C-H])", "Art. 5o finalidade e consentimento\n{1}"), (_TOP, "CAPITULO II\nDireitos\n{1}"), _BLANK],
    "OTHER": [_SENTENCE, ("^([O-S])", "as said (b) the transfer to a third country rests on adequacy. {1}"), ("^([I-N])", "1. They shall delete it within 30 days, or as required by law. {1}"), ("^([D-H])", "Section 3 consent of the consumer\n{1}"), (_TOP, "PART II\nDuties\n{1}"), _BLANK],
    "FLAT": [],
}


def statutes(spark: SparkSession, sf_dir: str, law: str) -> DataFrame:
    """(law, doc_id, text): all documents, built like this law."""
    text = F.col("text")
    for pattern, put in STRUCTURE[law]:
        text = F.regexp_replace(text, f"(?dm){pattern}", put.replace("{1}", "$1"))
    return _documents(spark, sf_dir).select(F.lit(law).alias("law"), "doc_id", text.alias("text"))


def statutes_sql(law: str) -> str:
    text = "text"
    for pattern, put in STRUCTURE[law]:
        put = " || chr(10) || ".join(quoted(x) for x in put.replace("{1}", "\\1").split("\n"))
        text = f"regexp_replace({text}, {quoted(f'(?m){pattern}')}, {put}, 'g')"
    return f"SELECT doc_id AS z, {text} AS body FROM documents"


def _chunked(name: str, law: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return chunk(statutes(spark, sf_dir, law), laws=[law]).withColumn("concept_tags", F.array_join("concept_tags", ","))

    QUERIES[name], ORACLE_SQL[name] = run, chunks_sql(law, statutes_sql(law))


for _name, _law in (("chunk_gdpr", "GDPR"), ("chunk_ccpa", "CCPA"), ("chunk_pipeda", "PIPEDA"), ("chunk_lgpd", "LGPD"), ("chunk_generic", "OTHER"), ("chunk_flat", "FLAT")):
    _chunked(_name, _law)

_LAW_OF = "'D' || CAST(z AS VARCHAR)"
_FOUND = f"CASE concept {' '.join(f"WHEN '{c}' THEN {_ruled(c)}" for c in PASS1_CONCEPTS)} END"


@query(
    f"SELECT law, article_ref, concept, true AS success, value IS NULL AS absent, value FROM (SELECT law, CAST(seq AS VARCHAR) AS article_ref, concept, {_FOUND} AS value FROM (SELECT *, lower(text) AS t FROM ({chunks_sql('OTHER', statutes_sql('OTHER'), _LAW_OF)}) "
    f"WHERE level IN ({listed(store.STRUCTURAL_LEVELS)[1:-1]})), (SELECT unnest({listed(PASS1_CONCEPTS)}) AS concept))"
)
def extract_statutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks, plan, rule-based back end and results, each document a law of its own and each structural chunk an article."""
    rows = statutes(spark, sf_dir, "OTHER").withColumn("law", F.concat(F.lit("D"), F.col("doc_id").cast("string")))
    articles = chunk(rows, laws=["OTHER"]).filter(F.col("level").isin(store.STRUCTURAL_LEVELS)).withColumn("article_ref", F.col("seq").cast("string"))
    out = ex.results(ex.extract(ex.plan(articles, PASS1_CONCEPTS, use_tags=False)))
    value = F.lit(None).cast("string")
    for c, path in _VALUE.items():
        value = F.when(F.col("concept") == c, F.get_json_object("json_str", f"$.{path}")).otherwise(value)
    return out.select("law", "article_ref", "concept", "success", "absent", F.when(~F.col("absent"), value).alias("value"))


# JSON of events: its parts are picked by digits of the event's id, some are the event's own.
def _digit(over: int, of: int) -> Column:
    return F.floor(F.col("event_id") / over).cast("long") % of


def _pick(values: list[str], over: int) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (_digit(over, len(values)) + 1).cast("int"))


def _pick_sql(values: list[str], over: int) -> str:
    return f"{listed(values)}[CAST((event_id // {over}) % {len(values)} + 1 AS BIGINT)]"


CHECKED = ["RetentionPolicy", "LegalBasis", "DataTransfer", "ConsentWithdrawal"]
_DATA = '[{"description": "d", "source": "s", "category": "Identifier", "sensitivity": "Low", "identifiability": "Identified"}]'
DURATIONS, UNITS = ['"3"', "3.0", "3.5", "true", '"x"', "-1", '" 1_0 "'], ["Years", "Days", "Weeks"]
TYPES, PLACES = ["Consent", "consent", " Consent", "Contract"], ["[]", '[{"name": "EU"}]', '[{"title": "EU"}]']
MECHANISMS, REFS = ["AdequacyDecision", "Consent"], ["null", '""', '"C(2021) 1"', '" "']
CHANNELS = ['"Email"', '["Email"]', '["Email", "Fax"]', "[]"]


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, concept, json_str): an answer of each event, right or not."""
    rows = read(spark, sf_dir, "events").select("event_id", "event_type", "props", _pick(CHECKED, 1).alias("concept"))
    quote = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    answers = {
        "RetentionPolicy": F.concat(F.lit('{"duration": '), _pick(DURATIONS, 4), F.lit(', "unit": '), quote(_pick(UNITS, 28)), F.lit(', "trigger": "ContractEnd"}')),
        "LegalBasis": F.concat(F.lit('{"type": '), quote(_pick(TYPES, 4)), F.lit(', "evidence": '), quote(F.col("event_type")), F.lit(', "jurisdiction": '), _pick(PLACES, 16), F.lit(', "further": '), F.col("props"), F.lit("}")),
        "DataTransfer": F.concat(F.lit('{"mechanism": '), quote(_pick(MECHANISMS, 4)), F.lit(', "adequacyDecisionRef": '), _pick(REFS, 8), F.lit(f', "destinationJurisdiction": [{{"name": "X"}}], "dataTransferred": {_DATA}}}')),
        "ConsentWithdrawal": F.concat(F.lit('{"channel": '), _pick(CHANNELS, 4), F.lit(', "deadline": '), quote(F.col("event_type")), F.lit(', "effect_on_prior_processing": ""}')),
    }
    out = F.lit(None).cast("string")
    for c, answer in answers.items():
        out = F.when(F.col("concept") == c, answer).otherwise(out)
    return rows.select("event_id", "concept", F.when(F.col("event_id") % 97 == 0, F.substring("props", 1, 4)).otherwise(out).alias("json_str"))


def _wrong_sql() -> str:
    """What is wrong with an event's answer, in words."""
    at = lambda over, of: f"(event_id // {over}) % {of}"
    one_of = lambda kind: f"not one of {', '.join(ENUMS[kind])}"
    said = {
        "RetentionPolicy": [(f"{at(4, 7)} IN (2, 4)", "duration: not a whole number"), (f"{at(28, 3)} = 2", f"unit: {one_of('RetentionUnit')}")],
        "LegalBasis": [(f"{at(4, 4)} IN (1, 2)", f"type: {one_of('LegalBasisType')}"), (f"{at(16, 3)} = 0", "jurisdiction: at least 1 needed"), (f"{at(16, 3)} = 2", "jurisdiction.0.name: missing")],
        "DataTransfer": [(f"{at(4, 2)} = 0 AND {at(8, 4)} <> 2", "adequacyDecisionRef: needed with AdequacyDecision")],
        "ConsentWithdrawal": [(f"{at(4, 4)} = 0", "channel: not a list"), (f"{at(4, 4)} = 2", f"channel.1: {one_of('WithdrawalChannel')}"), (f"{at(4, 4)} = 3", "channel: at least 1 needed")],
    }
    cases = " ".join(f"WHEN '{c}' THEN array_to_string(list_filter([{', '.join(f'CASE WHEN {when} THEN {quoted(text)} END' for when, text in rules)}], lambda x: x IS NOT NULL), '; ')" for c, rules in said.items())
    return f"CASE WHEN event_id % 97 = 0 THEN concept || ': not JSON' ELSE CASE concept {cases} END END"


@query(f"SELECT event_id, concept, wrong, wrong = '' AS valid FROM (SELECT event_id, concept, {_wrong_sql()} AS wrong FROM (SELECT *, {_pick_sql(CHECKED, 1)} AS concept FROM events))")
def validate_concept(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = validate(requests(spark, sf_dir), names=CHECKED)
    return out.select("event_id", "concept", F.array_join("errors", "; ").alias("wrong"), "valid")


@query(
    "SELECT event_id, CASE WHEN concept NOT IN (" + listed(LIST_CONCEPTS)[1:-1] + ") THEN raw WHEN kind IN (2, 3) THEN '[]' WHEN kind = 1 THEN raw ELSE '[' || raw || ']' END AS wrapped FROM ("
    f"SELECT event_id, (event_id // 9) % 4 AS kind, {_pick_sql(PASS1_CONCEPTS, 1)} AS concept, CASE (event_id // 9) % 4 WHEN 0 THEN props WHEN 1 THEN '[' || props || ']' WHEN 2 THEN '{{}}' ELSE left(props, 3) END AS raw FROM events)"
)
def wrap_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object, a list, nothing and bad JSON, of each concept."""
    kind = _digit(9, 4)
    raw = F.when(kind == 0, F.col("props")).when(kind == 1, F.concat(F.lit("["), "props", F.lit("]"))).when(kind == 2, F.lit("{}")).otherwise(F.substring("props", 1, 3))
    rows = read(spark, sf_dir, "events").select("event_id", _pick(PASS1_CONCEPTS, 1).alias("concept"), raw.alias("raw"))
    return rows.select("event_id", ex.wrap(F.col("concept"), F.col("raw")).alias("wrapped"))


# Statements of events, typed: action, sensitivity, basis and purposes by digits of the id, a risk assessment where the value is large.
_ACTIONS, _SENSITIVE, _BASES, _PURPOSES = ENUMS["ProcessingAction"], ENUMS["SensitivityLevel"], ENUMS["LegalBasisType"], ENUMS["PurposeCategory"]
_TRANSFER = '[{"mechanism": "AdequacyDecision", "adequacyDecisionRef": %s, "destinationJurisdiction": [{"name": "X"}], "dataTransferred": []}]'
_TRANSFERS = ["[]", _TRANSFER % "null", _TRANSFER % '"C(2021) 1"']
_WITHDRAWN = ["[]", '[{"channel": ["Email"], "deadline": "d", "effectOnPriorProcessing": "none"}]']
_REGULATED = ["[]", '[{"name": "EU"}]']


def typed_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, stmt)."""
    lit = F.lit
    raw = F.concat(
        lit('{"description": "d", "actor": {"name": "a", "role": "DataController"}, "purposes": [{"description": "p", "category": "'), _pick(_PURPOSES, 1), lit('"}, {"description": "q", "category": "'), _pick(_PURPOSES, 2),
        lit('"}], "processingActivity": {"description": "x", "action": "'), _pick(_ACTIONS, 1), lit('", "riskAssessmentReference": '), F.when(F.col("value") >= 100, lit('"Art. 35"')).otherwise(lit("null")),
        lit(', "dataProcessed": [{"description": "d", "source": "s", "category": "Identifier", "sensitivity": "'), _pick(_SENSITIVE, 6), lit('", "identifiability": "Identified"}]}, "legalBasis": {"type": "'), _pick(_BASES, 24),
        lit('", "evidence": "e", "jurisdiction": []}, "governingRegulations": [{"name": "r", "jurisdiction": '), _pick(_REGULATED, 7), lit('}], "dataTransfers": '), _pick(_TRANSFERS, 5), lit(', "consentWithdrawal": '), _pick(_WITHDRAWN, 3), lit("}"),
    )
    return read(spark, sf_dir, "events").select("event_id", F.from_json(raw, ddl("PolicyStatement")).alias("stmt"))


@query(
    f"SELECT event_id, {_pick_sql(_BASES, 24)} AS basis, array_to_string(list_sort(list_distinct([{_pick_sql(_PURPOSES, 1)}, {_pick_sql(_PURPOSES, 2)}])), ',') AS purposes, {_pick_sql(_ACTIONS, 1)} AS actions, {_pick_sql(_SENSITIVE, 6)} AS sensitivity, "
    "CASE WHEN (event_id // 5) % 3 > 0 THEN 'AdequacyDecision' ELSE '' END AS mechanisms, (event_id // 5) % 3 > 0 AS transfer, false AS retention, value >= 100 AS dpia, (event_id // 3) % 2 = 1 AS withdrawal FROM events"
)
def denorm_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = store.denormalised("stmt")
    shown = {"basis": "legal_basis_types", "purposes": "purpose_categories", "actions": "processing_actions", "sensitivity": "sensitivity_levels", "mechanisms": "transfer_mechanisms"}
    flags = {"transfer": "has_transfer", "retention": "has_retention", "dpia": "has_dpia", "withdrawal": "has_consent_withdrawal"}
    return typed_statements(spark, sf_dir).select("event_id", *[F.array_join(d[c], ",").alias(n) for n, c in shown.items()], *[d[c].alias(n) for n, c in flags.items()])


@query(
    f"SELECT event_id, concat_ws(',', CASE WHEN {_pick_sql(_ACTIONS, 1)} IN ('Transfer', 'Share') AND {_pick_sql(_SENSITIVE, 6)} IN ('High', 'SpecialCategory') AND value < 100 THEN 'risk assessment missing' END, "
    f"CASE WHEN {_pick_sql(_BASES, 24)} = 'Consent' AND (event_id // 3) % 2 = 0 THEN 'consent without withdrawal' END) AS warnings, "
    "concat_ws(',', CASE WHEN (event_id // 7) % 2 = 0 THEN 'regulation without jurisdiction' END, CASE WHEN (event_id // 5) % 3 = 1 THEN 'adequacy decision without reference' END) AS errors FROM events"
)
def ocl_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statement_rules(typed_statements(spark, sf_dir)).select("event_id", F.array_join("warnings", ",").alias("warnings"), F.array_join("rule_errors", ",").alias("errors"))


@query("SELECT l_orderkey, l_linenumber, CAST(CAST(round_even(CAST(l_quantity AS DOUBLE) / 64 * 100, 0) AS BIGINT) AS VARCHAR) || '%' AS shown FROM lineitem")
def percent_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty-fourths, so that halves come up."""
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", percent(F.col("l_quantity").cast("double") / 64).alias("shown"))


#: Each keyword of either table, every other one in capitals.
_WORDS = [w.upper() if i % 2 else w for table in (KEYWORDS, PIPEDA_KEYWORDS) for words in table.values() for i, w in enumerate(words)]
_BY_TABLE = ["list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(t, {quoted(w)})" for w in words) + f" THEN '{c}' END" for c, words in table.items()) + "], lambda x: x IS NOT NULL)" for table in (PIPEDA_KEYWORDS, KEYWORDS)]


@query(
    f"SELECT doc_id, law, array_to_string(CASE WHEN law = 'pipeda' THEN {_BY_TABLE[0]} ELSE {_BY_TABLE[1]} END, ',') AS tags FROM (SELECT doc_id, CASE WHEN (doc_id // {len(_WORDS)}) % 2 = 0 THEN 'GDPR' ELSE 'pipeda' END AS law, "
    f"lower(text || ' ' || {listed(_WORDS)}[CAST(doc_id % {len(_WORDS)} + 1 AS BIGINT)]) AS t FROM documents)"
)
def law_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that end with a keyword, under a law of each table."""
    word = F.element_at(F.array(*[F.lit(w) for w in _WORDS]), (F.col("doc_id") % len(_WORDS) + 1).cast("int"))
    law = F.when(F.floor(F.col("doc_id") / len(_WORDS)) % 2 == 0, "GDPR").otherwise("pipeda")
    rows = _documents(spark, sf_dir).select("doc_id", law.alias("law"), F.concat_ws(" ", "text", word).alias("text"))
    return tagging.tag(rows).select("doc_id", "law", F.array_join("concept_tags", ",").alias("tags"))
