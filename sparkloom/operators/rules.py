"""Rules that emit findings. A rule is a predicate over a leaf's text; a registry gives its code, severity and pattern.

Every rule family returns the same columns, and a report is their union. Patterns keep to what Java and RE2 both
read, so that SQL engines can check them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    code: str
    severity: str
    pattern: str
    needs: tuple[str, ...] = ()  # in lower case: a text without any of these cannot match

    def may_match(self, text: Column) -> Column:
        """A cheap test before the pattern; the text in lower case is made once for all rules."""
        low = F.lower(text)
        return reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in self.needs]) if self.needs else F.lit(True)

    def replaced(self, text: Column) -> Column:
        """The text with the rule's name in place of what it finds."""
        return F.when(self.may_match(text), F.regexp_replace(text, self.pattern, f"<{self.code.lower()}>")).otherwise(text)


# Rule codes and patterns by family.
DATA_EXPOSURE = (
    Rule("PII_EMAIL", "warning", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", ("@",)),
    Rule("PII_PHONE", "warning", r"\+?\d{1,3}[ -]\(?\d{2,4}\)?[ -]\d{3,4}[ -]?\d{3,4}"),
    Rule("PII_CARD", "error", r"\b\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}\b"),
    Rule("PII_SSN", "error", r"\b\d{3}-\d{2}-\d{4}\b"),
)
SECRETS = (
    Rule("SECRET_AWS_KEY", "error", r"\bAKIA[0-9A-Z]{16}\b", ("akia",)),
    Rule("SECRET_BEARER", "error", r"(?i)bearer [a-z0-9._-]{16,}", ("bearer ",)),
    Rule("SECRET_PRIVATE_KEY", "error", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", ("-----begin",)),
    Rule("SECRET_TOKEN", "error", r"\b(?:ghp|sk|xox[bp])[-_][A-Za-z0-9]{16,}", ("ghp", "sk-", "sk_", "xox")),
    Rule("SECRET_ASSIGNMENT", "warning", r"(?i)(?:password|api[_-]?key|secret)\s*[:=]\s*\S{6,}", ("password", "api", "secret")),
)
URLS = (
    Rule("URL_PLAINTEXT", "warning", r"^http://"),
    Rule("URL_CREDENTIALS", "error", r"^[a-z]+://[^/@\s]+:[^/@\s]+@"),
    Rule("URL_LOCAL_HOST", "error", r"^[a-z]+://(?:localhost|127\.|10\.|192\.168\.|169\.254\.|0\.0\.0\.0)"),
    Rule("URL_IP_LITERAL", "warning", r"^[a-z]+://\d{1,3}(?:\.\d{1,3}){3}(?:[:/]|$)"),
    Rule("URL_TRACKING", "info", r"[?&]utm_[a-z]+="),
)
CONTENT = (
    Rule("HTML_SCRIPT", "error", r"(?i)<script[\s>]", ("<script",)),
    Rule("HTML_EVENT_HANDLER", "error", r"(?i)<[a-z][^>]*\son[a-z]+\s*="),
    Rule("HTML_IFRAME", "warning", r"(?i)<iframe[\s>]", ("<iframe",)),
    Rule("HTML_JS_URL", "error", r"(?i)javascript:", ("javascript:",)),
)
SQL = (
    Rule("SQL_STACKED", "error", r"(?i);\s*(?:drop|delete|insert|update|alter)\s", (";",)),
    Rule("SQL_UNION", "warning", r"(?i)\bunion\s+(?:all\s+)?select\b", ("union",)),
    Rule("SQL_SELECT_STAR", "info", r"(?i)\bselect\s+\*\s+from\b", ("select",)),
    Rule("SQL_UNBOUNDED_DELETE", "error", r"(?i)\bdelete\s+from\s+\w+\s*(?:;|$)", ("delete",)),
    Rule("SQL_TEMPLATE", "warning", r"(?i)\b(?:select|insert|update|delete)\b[^;]*\{\{", ("{{",)),
)
CRYPTO = (Rule("CRYPTO_WEAK_HASH", "warning", r"(?i)\b(?:md5|sha1)\b", ("md5", "sha1")), Rule("CRYPTO_ECB", "error", r"(?i)\becb\b", ("ecb",)))
REDIRECT = (Rule("REDIRECT_OPEN", "warning", r"(?i)[?&](?:redirect|next|return|url)(?:_?(?:to|url|uri))?="),)
NOTES = (Rule("NOTE_TODO", "info", r"\b(?:TODO|FIXME|XXX)\b", ("todo", "fixme", "xxx")), Rule("NOTE_CREDENTIAL_WORD", "warning", r"(?i)\b(?:password|passwort|contraseña)\b", ("password", "passwort", "contraseña")))
GRAPHQL = (Rule("GRAPHQL_INTROSPECTION", "warning", r"__schema|__type\b", ("__schema", "__type")), Rule("GRAPHQL_MUTATION", "info", r"(?i)\bmutation\b\s*\w*\s*[({]", ("mutation",)))
FAMILIES = {
    "data_exposure": DATA_EXPOSURE, "secrets": SECRETS, "urls": URLS, "content": CONTENT, "sql": SQL,
    "crypto": CRYPTO, "redirect": REDIRECT, "notes": NOTES, "graphql": GRAPHQL,
}


def findings(rows: DataFrame, ids: Sequence[str], text: str, rules: Sequence[Rule]) -> DataFrame:
    """ids, code, severity of each row and rule that match: one scan, whatever the number of rules."""
    hits = [F.when(r.may_match(F.col(text)) & F.col(text).rlike(r.pattern), F.struct(F.lit(r.code).alias("code"), F.lit(r.severity).alias("severity"))) for r in rules]
    return rows.select(*ids, F.explode(F.array_compact(F.array(*hits))).alias("f")).select(*ids, "f.code", "f.severity")


def report(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def with_finding_id(found: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Adds finding_id: a hash of the ids and the code. A null id, and one that holds a bar or a backslash, are told from all others."""

    def cell(name: str) -> Column:
        text = F.replace(F.replace(F.col(name).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
        return F.coalesce(text, F.lit("\\0"))

    return found.withColumn("finding_id", F.sha2(F.concat_ws("|", *map(cell, ids), "code"), 256))


def allowed_violations(rows: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Values outside the allowed set, with their counts."""
    return rows.where(~F.col(column).isin(*allowed) | F.col(column).isNull()).groupBy(F.coalesce(F.col(column), F.lit("<null>")).alias("value")).agg(F.count("*").alias("n"))


def pattern_violations(rows: DataFrame, column: str, pattern: str) -> DataFrame:
    """Values that the pattern does not match whole."""
    return rows.where(~F.col(column).rlike(f"^(?:{pattern})$")).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def json_key_violations(rows: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """Keys of JSON objects that are not allowed; text that is no object counts as <invalid_json>."""
    found = F.coalesce(F.json_object_keys(column), F.array(F.lit("<invalid_json>")))
    return rows.select(F.explode(found).alias("value")).where(~F.col("value").isin(*keys)).groupBy("value").agg(F.count("*").alias("n"))


def json_array_violations(rows: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Items of JSON arrays that are not allowed, with their counts.

    Text that does not parse counts as <invalid_json>, text of another kind as <non_array_json>, an item that is no text or blank as <non_text_value>. A null is skipped.
    """
    kept = rows.where(F.col(column).isNotNull()).select(F.col(column).alias("raw"))
    parsed = F.try_parse_json("raw")
    kind = F.schema_of_variant(parsed)
    texts = F.expr("transform(cast(try_parse_json(raw) AS array<variant>), v -> if(schema_of_variant(v) = 'STRING' AND trim(cast(v AS string)) <> '', cast(v AS string), '<non_text_value>'))")
    found = F.when(parsed.isNull(), F.array(F.lit("<invalid_json>"))).when(~F.startswith(kind, F.lit("ARRAY")), F.array(F.lit("<non_array_json>"))).otherwise(texts)
    return kept.select(F.explode(found).alias("value")).where(~F.col("value").isin(*allowed)).groupBy("value").agg(F.count("*").alias("n"))


def redact(text: Column, rules: Sequence[Rule] = (*DATA_EXPOSURE, *SECRETS)) -> Column:
    for r in rules:
        # Bound as a variable of transform(), the text so far stands in the expression once, not three times at each rule.
        text = F.get(F.transform(F.array(text), r.replaced), 0)
    return text


def required_missing(nodes: DataFrame, required: DataFrame, leaves: DataFrame) -> DataFrame:
    """(bp_id, node_path, field) of required fields (module_token, field) that a node of the module does not hold."""
    wanted = nodes.join(required, "module_token").select("bp_id", "node_path", "field")
    held = leaves.select("bp_id", "node_path", F.col("key").alias("field")).where("value IS NOT NULL AND value <> ''").distinct()
    return wanted.join(held, ["bp_id", "node_path", "field"], "left_anti")


def resolve(tokens: DataFrame, modules: DataFrame, token: str, key: str) -> DataFrame:
    """Each token as known (one module), ambiguous (several) or unknown (none)."""
    counted = modules.groupBy(F.col(key).alias(token)).agg(F.count("*").alias("_n"))
    status = F.when(F.col("_n").isNull(), "unknown").when(F.col("_n") == 1, "known").otherwise("ambiguous")
    return tokens.join(counted, token, "left").withColumn("status", status).drop("_n")


def filter_condition(operator: str, a: Column, b: Column | None = None) -> Column:
    """A route filter's comparison (one of shapes.FILTER_OPERATORS, space and case aside) as a Column. Numbers are compared as numbers, texts as texts."""
    name = operator.strip().lower()
    if name in ("exist", "exists"):
        return a.isNotNull()
    if name in ("notexist", "does not exist"):
        return a.isNull()
    kind, _, rest = name.partition(":") if name.startswith(("number:", "text:")) else ("", "", name)
    ci = rest.endswith((":ci", "(case insensitive)"))
    core = rest.removesuffix(":ci").removesuffix("(case insensitive)").strip()
    order = {"gt": "greater", "gte": "greaterorequal", "lt": "less", "lte": "lessorequal", "less than": "less"}.get(core, core)
    if b is None:
        raise ValueError(f"filter operator {operator!r} compares two values")
    if kind == "number" or order in ("greater", "greaterorequal", "less", "lessorequal"):
        a, b = a.cast("string").try_cast("double"), b.cast("string").try_cast("double")
    elif ci:
        a, b = F.lower(a.cast("string")), F.lower(b.cast("string"))
    table = {
        "equal": lambda: a == b, "equal to": lambda: a == b, "not equal": lambda: a != b, "not equal to": lambda: a != b, "notequal": lambda: a != b, "contains": lambda: F.contains(a, b),
        "greater": lambda: a > b, "greaterorequal": lambda: a >= b, "less": lambda: a < b, "lessorequal": lambda: a <= b,
    }
    if order not in table:
        raise ValueError(f"unknown filter operator {operator!r}")
    return table[order]()
