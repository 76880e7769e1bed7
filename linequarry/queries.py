"""The engine's queries over the tables, with the SQL that gives the same rows.

A row of `documents` stands for a file, its doc_id for the path; `pages`, `conversations`,
`benchmark` and `events` are corpora of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linequarry.functions import render
from linequarry.operators import inspect as ins
from linequarry.operators import lines as ln
from linequarry.operators import probes
from linequarry.operators import search as se
from linequarry.plans.compat import lower_patterns
from linequarry.plans.expression import parse

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DOC = ["doc_id"]


def docs(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def lines_sql(table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    return f"""
  SELECT {key}, line, CASE WHEN ends_with(part, chr(13)) THEN part[:-2] ELSE part END AS text FROM (
    SELECT {key}, unnest(string_split({text}, chr(10))) AS part, generate_subscripts(string_split({text}, chr(10)), 1) AS line,
           len(string_split({text}, chr(10))) AS n FROM {table})
  WHERE line < n OR part <> ''"""


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def hits_sql(test: str, column: str, table: str = "documents", key: str = "doc_id", text: str = "text", tail: str = "") -> str:
    return f"""WITH lines AS ({lines_sql(table, key, text)})
SELECT {key}, CAST(line AS BIGINT) AS line, CAST({column} AS BIGINT) AS "column", text[1:220] AS preview FROM lines WHERE {test} {tail}"""


def at_literal(x: str) -> str:
    return f"strlen(text[1:instr(text, {q(x)}) - 1]) + 1"


def at_regex(p: str) -> str:
    return f"strlen(regexp_extract(text, {q('(?s)^(.*?)(?:' + p + ')')}, 1)) + 1"


def add_hits(name: str, expr: str, test: str, column: str, table: str = "documents", keys: list[str] = DOC, text: str = "text") -> None:
    plan = parse(expr)
    add(name, lambda s, d: se.hits(docs(s, d, table), keys, plan, text), hits_sql(test, column, table, ", ".join(keys), text))


def by_file(name: str, query: Callable[[DataFrame], DataFrame], sql: str) -> None:
    add(name, lambda s, d: query(docs(s, d)), sql)


# --- hits

add_hits("lit_hits", "lit:the", "contains(text, 'the')", at_literal("the"))
add_hits("prefix_hits", "prefix:The", "starts_with(text, 'The')", "1")
add_hits("suffix_hits", "suffix:on.", "ends_with(text, 'on.')", "strlen(text) - 2")
add_hits("regex_hits", r"re:\w+\s+the\s+\w+", r"regexp_matches(text, '\w+\s+the\s+\w+')", at_regex(r"\w+\s+the\s+\w+"))
add_hits("and_hits", "lit:the && lit:of && suffix:.", "contains(text, 'the') AND contains(text, 'of') AND ends_with(text, '.')", f"least({at_literal('the')}, {at_literal('of')}, strlen(text))")
add_hits("or_hits", "lit:MIT || lit:Apache", "contains(text, 'MIT') OR contains(text, 'Apache')", f"least(CASE WHEN contains(text, 'MIT') THEN {at_literal('MIT')} END, CASE WHEN contains(text, 'Apache') THEN {at_literal('Apache')} END)")
add_hits("word_boundary_hits", r"re:\bof\b", r"regexp_matches(text, '\bof\b')", at_regex(r"\bof\b"))
add_hits("non_ascii_word_boundary_hits", r"re:\bla\b", r"regexp_matches(text, '\bla\b')", at_regex(r"\bla\b"))
add_hits("ci_literal_hits", "re:(?i)mit", "regexp_matches(text, '(?i)mit')", at_regex("(?i)mit"))
add_hits("ci_word_hits", r"re:(?i)\bthe\b", r"regexp_matches(text, '(?i)\bthe\b')", at_regex(r"(?i)\bthe\b"))
add_hits("alternates_hits", "re:(Apache|MIT|GNU)", "regexp_matches(text, '(Apache|MIT|GNU)')", at_regex("(Apache|MIT|GNU)"))
add_hits("non_ascii_column", "lit:ß", "contains(text, 'ß')", at_literal("ß"))
add_hits("min_column_or", "lit:und || prefix:Der || re:[0-9]+", "contains(text, 'und') OR starts_with(text, 'Der') OR regexp_matches(text, '[0-9]+')",
         f"least(CASE WHEN contains(text, 'und') THEN {at_literal('und')} END, CASE WHEN starts_with(text, 'Der') THEN 1 END, CASE WHEN regexp_matches(text, '[0-9]+') THEN {at_regex('[0-9]+')} END)")
add_hits("email_hits", r"re:[A-Za-z0-9._]+@[A-Za-z0-9.]+", "regexp_matches(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+')", at_regex("[A-Za-z0-9._]+@[A-Za-z0-9.]+"))
add_hits("anchored_hits", r"re:^[A-Z][a-z]+,.*\.$", r"regexp_matches(text, '^[A-Z][a-z]+,.*\.$')", "1")
add_hits("pages_regex", r're:href="/[a-z]+"', "regexp_matches(text, 'href=\"/[a-z]+\"')", at_regex('href="/[a-z]+"'), "pages", ["page_id"], "html")
add_hits("conversation_matches", "lit:the || lit:der", "contains(text, 'the') OR contains(text, 'der')", f"least(CASE WHEN contains(text, 'the') THEN {at_literal('the')} END, CASE WHEN contains(text, 'der') THEN {at_literal('der')} END)", "conversations", ["conv_id", "turn"])
add_hits("event_props_literal", 'lit:"', "contains(text, '\"')", at_literal('"'), "events", ["event_id"], "props")
add_hits("grep_lowered_multi", lower_patterns(["Apache", "MIT.License"]), "regexp_matches(text, 'Apache|MIT.License')", f"least(CASE WHEN contains(text, 'Apache') THEN {at_literal('Apache')} END, CASE WHEN regexp_matches(text, 'MIT.License') THEN {at_regex('MIT.License')} END)")
add_hits("grep_lowered_fixed_fold", lower_patterns(["by-nc 4.0"], fixed_strings=True, ignore_case=True), r"regexp_matches(text, '(?i)by-nc 4\.0')", at_regex(r"(?i)by-nc 4\.0"))
add_hits("mixed_operators", "The && of || Licensed", "contains(text, 'The && of') OR contains(text, 'Licensed')", f"coalesce(CASE WHEN contains(text, 'Licensed') THEN {at_literal('Licensed')} END, 1)")

THE = hits_sql("contains(text, 'the')", at_literal("the"))
add("preview_220", lambda s, d: se.hits(docs(s, d), DOC, parse("lit:en")).where(F.octet_length("preview") > 220).select("doc_id", "line", "preview", F.char_length("preview").cast("long").alias("n_chars")),
    f"SELECT doc_id, line, preview, CAST(length(preview) AS BIGINT) AS n_chars FROM ({hits_sql('contains(text, $$en$$)', at_literal('en'))}) WHERE strlen(preview) > 220")
add("top_hits", lambda s, d: se.hits(docs(s, d), DOC, parse("lit:the"), max_hits=50), THE + ' ORDER BY doc_id, line, "column" LIMIT 50')
add("hits_per_file_cap", lambda s, d: se.hits(docs(s, d), DOC, parse("lit:the"), per_file=2), f"SELECT * FROM ({THE}) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line) <= 2")
add("rendered_hits", lambda s, d: render.hit_text(se.hits(docs(s, d), DOC, parse("lit:License")), "doc_id"),
    f"""SELECT concat_ws(':', doc_id, line, "column", preview) AS rendered FROM ({hits_sql("contains(text, 'License')", at_literal('License'))})""")


# --- counts


def per_doc(value: str, name: str, table: str = "documents", key: str = "doc_id") -> str:
    return f"SELECT {key}, CAST({value} AS BIGINT) AS {name} FROM {table}"


def lines_of(test: str) -> str:
    return f"""WITH lines AS ({lines_sql()})
SELECT d.doc_id, count(l.line) AS n_lines FROM documents d LEFT JOIN lines l ON l.doc_id = d.doc_id AND {test} GROUP BY d.doc_id"""


occurrences = lambda expr, scope="file": lambda f: se.count_occurrences(f, DOC, parse(expr), scope=scope)
found = lambda p: f"len(regexp_extract_all(text, {q(p)}))"
by_file("count_lines", lambda f: se.count_lines(f, DOC, parse("lit:the")), lines_of("contains(l.text, 'the')"))
by_file("count_lines_and", lambda f: se.count_lines(f, DOC, parse(r"lit:the && re:\bof\b")), lines_of(r"contains(l.text, 'the') AND regexp_matches(l.text, '\bof\b')"))
by_file("count_occurrences", occurrences("lit:the"), per_doc("(strlen(text) - strlen(replace(text, 'the', ''))) / 3", "n_occurrences"))
by_file("occurrences_per_file", occurrences(r"re:[A-Z]\w+"), per_doc(found(r"[A-Z]\w+"), "n_occurrences"))
by_file("alternates_occurrences", occurrences("re:(there|the|th)"), per_doc(found("there|the|th"), "n_occurrences"))
by_file("ci_occurrences", occurrences("re:(?i)mit"), per_doc(found("(?i)mit"), "n_occurrences"))
by_file("word_occurrences", occurrences(r"re:\bthe\b"), per_doc(found(r"\bthe\b"), "n_occurrences"))
by_file("ci_word_occurrences", occurrences(r"re:(?i)\bder\b"), per_doc(found(r"(?i)\bder\b"), "n_occurrences"))
by_file("space_run_occurrences", occurrences(r"re:\s+\w"), per_doc(found(r"\s+\w"), "n_occurrences"))
by_file("line_scope_occurrences", occurrences("lit:aa", "line"), f"""WITH lines AS ({lines_sql()})
SELECT doc_id, CAST(sum((strlen(text) - strlen(replace(text, 'aa', ''))) / 2) AS BIGINT) AS n_occurrences FROM lines GROUP BY doc_id""")  # fmt: skip
by_file("no_literal_occurrences", occurrences(r"re:\w{5}\s+\w{5}\s+\w{5}"), per_doc(found(r"\w{5}\s+\w{5}\s+\w{5}"), "n_occurrences"))
by_file("unicode_casefold_count", lambda f: se.unicode_casefold_count(f, DOC, parse("re:(?i)für")),
        f"SELECT doc_id, n_occurrences, prefix_hits, greatest(prefix_hits - n_occurrences, 0) AS rejected FROM (SELECT doc_id, CAST({found('(?i)für')} AS BIGINT) AS n_occurrences, CAST({found('(?i)f')} AS BIGINT) AS prefix_hits FROM documents)")
by_file("matches_found_stats_only", lambda f: se.matches_found(f, DOC, parse("lit:the")), per_doc("(strlen(text) - strlen(replace(text, 'the', ''))) / 3", "n_matches"))
by_file("matches_found_hits", lambda f: se.matches_found(f, DOC, parse("lit:the"), collect_hits=True), lines_of("contains(l.text, 'the')").replace("n_lines", "n_matches"))

DECOMPOSED = r"\w+\s+with\s+\w+"


def decomposed_sql(source: str, key: str, word: str, most: int) -> str:
    """Of each file: lines with the word between words are candidates, up to most; its further places on them are duplicates."""
    lines = lines_sql(source, key)
    return f"""WITH lines AS ({lines}),
t AS (SELECT {key}, line, text, string_split_regex(text, '\\s+') AS w FROM lines),
n AS (SELECT {key}, line, regexp_matches(text, '\\w+\\s+{word}\\s+\\w+') AS hit,
             len(list_filter(range(2, len(w)), lambda i: w[i] = '{word}' AND regexp_matches(w[i - 1], '\\w$') AND regexp_matches(w[i + 1], '^\\w'))) AS k FROM t),
c AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY line) AS nth FROM n WHERE k > 0)
SELECT f.{key}, count(c.line) FILTER (nth <= {most}) AS candidate_lines, CAST(coalesce(sum(k - 1) FILTER (nth <= {most}), 0) AS BIGINT) AS duplicates_skipped,
       count(c.line) FILTER (hit AND nth <= {most}) AS matched_lines, count(c.line) > {most} AS bailed_out
FROM {source} f LEFT JOIN c ON c.{key} = f.{key} GROUP BY f.{key}"""


STATS_SQL = """SELECT count(*) AS eligible, count(*) FILTER (NOT bailed_out) AS counted, count(*) FILTER (bailed_out) AS bailed, CAST(sum(candidate_lines) AS BIGINT) AS candidate_lines,
       CAST(sum(duplicates_skipped) AS BIGINT) AS duplicates_skipped, CAST(sum(matched_lines) AS BIGINT) AS matched_lines FROM"""
by_file("decomposition_counts", lambda f: se.decomposition(f, DOC, parse("re:" + DECOMPOSED)).drop("n_matches"), decomposed_sql("documents", "doc_id", "with", se.BAIL_OUT))
by_file("decomposition_stats", lambda f: se.decomposition_stats(f, DOC, parse("re:" + DECOMPOSED)), f"{STATS_SQL} ({decomposed_sql('documents', 'doc_id', 'with', se.BAIL_OUT)})")
#: Files of 1 to 7,201 lines; those of over 4,096 candidates bail out.
LONG_FILES = "(SELECT n_nationkey, n_name || chr(10) || repeat(n_name || ' sent with care' || chr(10) || 'with ' || n_name || ' or with it or with them' || chr(10), 150 * n_nationkey) AS text FROM nation)"


def long_files(s: SparkSession, d: str) -> DataFrame:
    twice = F.concat("n_name", F.lit(" sent with care\nwith "), "n_name", F.lit(" or with it or with them\n"))
    return docs(s, d, "nation").select("n_nationkey", F.concat("n_name", F.lit("\n"), F.repeat(twice, (150 * F.col("n_nationkey")).cast("int"))).alias("text"))


add("decomposition_bail_out", lambda s, d: se.decomposition(long_files(s, d), ["n_nationkey"], parse("re:" + DECOMPOSED)).drop("n_matches"), decomposed_sql(LONG_FILES, "n_nationkey", "with", se.BAIL_OUT))
add("decomposition_bail_out_stats", lambda s, d: se.decomposition_stats(long_files(s, d), ["n_nationkey"], parse("re:" + DECOMPOSED)), f"{STATS_SQL} ({decomposed_sql(LONG_FILES, 'n_nationkey', 'with', se.BAIL_OUT)})")
# Lines where there are few candidates, occurrences in files that bail out.
add("matches_found_decomposed", lambda s, d: se.matches_found(long_files(s, d), ["n_nationkey"], parse("re:" + DECOMPOSED)),
    f"""SELECT d.n_nationkey, CASE WHEN bailed_out THEN CAST(len(regexp_extract_all(f.text, {q(DECOMPOSED)})) AS BIGINT) ELSE matched_lines END AS n_matches
FROM ({decomposed_sql(LONG_FILES, 'n_nationkey', 'with', se.BAIL_OUT)}) d JOIN {LONG_FILES} f ON f.n_nationkey = d.n_nationkey""")  # fmt: skip
by_file("matches_found_generic", lambda f: se.matches_found(f, DOC, parse(r"re:[A-Z]\w+")), per_doc(found(r"[A-Z]\w+"), "n_matches"))
by_file("matches_found_casefold", lambda f: se.matches_found(f, DOC, parse("re:(?i)für")), per_doc(found("(?i)für"), "n_matches"))
by_file("run_stats", lambda f: se.run_stats(f, DOC, parse("lit:the")), f"""WITH lines AS ({lines_sql()})
SELECT (SELECT count(*) FROM documents) AS files_discovered, (SELECT count(*) FROM documents) AS files_scanned, CAST(0 AS BIGINT) AS files_skipped,
       (SELECT CAST(sum(strlen(text)) AS BIGINT) FROM documents) AS bytes_scanned, count(*) FILTER (contains(text, 'the')) AS matches_found FROM lines""")  # fmt: skip
by_file("line_profile", lambda f: ln.line_profile(f, DOC), f"""WITH lines AS ({lines_sql()})
SELECT doc_id, count(*) AS line_count, CAST(sum(strlen(text)) AS BIGINT) AS line_bytes, CAST(max(strlen(text)) AS BIGINT) AS longest_line FROM lines GROUP BY doc_id""")  # fmt: skip
by_file("largest_files", lambda f: se.largest_files(f, DOC), "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes FROM documents ORDER BY bytes DESC, doc_id LIMIT 5")
by_file("file_tier_histogram", ln.size_tiers, """SELECT CASE WHEN strlen(text) < 16384 THEN 'tiny' WHEN strlen(text) <= 262144 THEN 'heap' ELSE 'mapped' END AS tier,
       count(*) AS n_files, CAST(sum(strlen(text)) AS BIGINT) AS total_bytes FROM documents GROUP BY 1""")  # fmt: skip
by_file("loop_summary", lambda f: se.loop_summary(f.select(F.col("n_chars").cast("double").alias("ms"))),
        """SELECT CAST(len(v) AS BIGINT) AS loops, v[1] AS min, list_sum(v) / len(v) AS mean, v[least(CAST(floor(len(v) * 0.95) AS INT) + 1, len(v))] AS p95,
       v[len(v) // 2 + 1] AS median, v[len(v)] AS max FROM (SELECT list(CAST(n_chars AS DOUBLE) ORDER BY n_chars) AS v FROM documents)""")  # fmt: skip


# --- probes


def alternation_sql(literals: list[str]) -> str:
    """Literals of which none can begin inside another, so that ranges find what the whole has."""
    longest = max(map(len, literals))
    per = ", ".join([f"{found('|'.join(literals))} AS whole", "length(text) AS size",
                     " + ".join(f"(length(text) - length(replace(text, {q(x)}, ''))) // {len(x)}" for x in literals) + " AS alone",
                     *[f"list_sum(list_transform(range(1, {n + 1}), lambda k: least({longest - 1}, length(text) - (k * length(text)) // {n}))) AS more_{n}" for n in probes.RANGES]])
    row = lambda name, n, read: f"SELECT '{name}' AS variant, CAST(sum({n}) AS BIGINT) AS n_occurrences, CAST(sum({read}) AS BIGINT) AS read_chars, sum({n}) = sum(whole) AS comparable FROM c"
    rows = [*[row(x, "whole", "size") for x in ("whole", "gated", "lines")], row("literal_sum", "alone", f"size * {len(literals)}"), *[row(f"ranges_{n}", "whole", f"size + more_{n}") for n in probes.RANGES]]
    return f"WITH c AS (SELECT {per} FROM documents) " + " UNION ALL ".join(rows)


for name, literals in {"alternation_probe": ["Apache", "MIT", "GNU"], "alternation_probe_nested": ["there", "the", "th"]}.items():
    by_file(name, lambda f, literals=literals: probes.alternation(f, literals), alternation_sql(literals))
SHORT_WORDS = r"\w{5}\s+\w{5}\s+\w{5}"
by_file("no_literal_probe", lambda f: probes.no_literal(f, SHORT_WORDS), f"""WITH c AS (SELECT {found(SHORT_WORDS)} AS n FROM documents)
SELECT unnest(['all', 'first_then_rest', 'test_then_all']) AS variant, CAST(sum(n) AS BIGINT) AS n FROM c
UNION ALL SELECT 'test', count(*) FILTER (n > 0) FROM c""")  # fmt: skip


# --- windows and context

window_sql = lambda test: f"SELECT doc_id, CAST(line AS BIGINT) AS line, text FROM ({lines_sql()}) WHERE {test}"
by_file("window_head", lambda f: ins.window(f, DOC, total_count=2), window_sql("line <= 2"))
by_file("window_skip_limit", lambda f: ins.window(f, DOC, skip=3, limit=4), window_sql("line > 3 AND line <= 7"))
by_file("window_range", lambda f: ins.window(f, DOC, range_="2:3"), window_sql("line BETWEEN 2 AND 3"))
by_file("window_start_limit", lambda f: ins.window(f, DOC, start_line=5, limit=2), window_sql("line BETWEEN 5 AND 6"))
by_file("window_past_end", lambda f: ins.window(f, DOC, start_line=40, end_line=60), window_sql("line BETWEEN 40 AND 60"))
by_file("window_emitted", lambda f: ins.window_reports(f, DOC, range_="2:3").select("doc_id", "total_emitted_lines"),
        f"SELECT d.doc_id, count(l.line) AS total_emitted_lines FROM documents d LEFT JOIN ({lines_sql()}) l ON l.doc_id = d.doc_id AND l.line BETWEEN 2 AND 3 GROUP BY d.doc_id")


def context_sql(test: str, before: int, after: int, cap: str = "") -> str:
    return f"""WITH lines AS ({lines_sql()}), hit AS (SELECT doc_id, line FROM lines WHERE {test} {cap}),
near AS (SELECT l.doc_id, l.line, l.text, bool_or(l.line = h.line) AS own FROM lines l JOIN hit h
         ON h.doc_id = l.doc_id AND l.line BETWEEN h.line - {before} AND h.line + {after} GROUP BY ALL)
SELECT doc_id, CAST(line AS BIGINT) AS line, CASE WHEN own THEN 'match' ELSE 'context' END AS role, text FROM near"""


by_file("context_symmetric", lambda f: ins.context(f, DOC, parse("lit:MIT"), context=2), context_sql("contains(text, 'MIT')", 2, 2))
by_file("context_before_after", lambda f: ins.context(f, DOC, parse("lit:Licensed"), context=2, before=1, after=3), context_sql("contains(text, 'Licensed')", 1, 3))
by_file("context_frame", lambda f: ins.context_in_row(f, DOC, parse("lit:Licensed"), before=1, after=3), context_sql("contains(text, 'Licensed')", 1, 3))
by_file("context_capped", lambda f: ins.context(f, DOC, parse("lit:the"), context=1, max_hits=20), context_sql("contains(text, 'the')", 1, 1, "ORDER BY doc_id, line LIMIT 20"))
by_file("context_zero", lambda f: ins.context(f, DOC, parse("prefix:Released")), context_sql("starts_with(text, 'Released')", 0, 0))
by_file("coalesced_ranges", lambda f: ins.context_ranges(f, DOC, parse("lit:und"), before=1, after=1), f"""WITH lines AS ({lines_sql()}),
r AS (SELECT doc_id, CAST(greatest(line - 1, 1) AS BIGINT) AS s, CAST(line + 1 AS BIGINT) AS e FROM lines WHERE contains(text, 'und')),
m AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM r),
i AS (SELECT *, sum(CASE WHEN far IS NULL OR s > far + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT doc_id, min(s) AS start_line, max(e) AS end_line FROM i GROUP BY doc_id, island""")  # fmt: skip


# --- several roots, explain


def two_roots(s: SparkSession, d: str) -> DataFrame:
    one = docs(s, d).select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), "text")
    two = docs(s, d, "benchmark").select(F.concat(F.lit("b/"), F.col("item_id").cast("string")).alias("path"), "text")
    both = one.unionByName(two).unionByName(two).dropDuplicates(["path"])
    return se.hits(both, ["path"], parse("lit:the"))


BOTH = "(SELECT 'd/' || doc_id AS path, text FROM documents UNION ALL SELECT 'b/' || item_id AS path, text FROM benchmark)"
add("multi_root_dedupe", two_roots, hits_sql("contains(text, 'the')", at_literal("the"), BOTH, "path"))


EXPRESSIONS = ["lit:the", "prefix:The", r"re:\bof\b", "re:(?i)mit", "re:(a|b)", r"re:\w+\s+Holmes\s+\w+", "re:[0-9]+", "a && b || c", " x && suffix:y. && prefix:z ", "lit:a || || re:b|c"]


def explained(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([(e, parse(e).explain_json()) for e in EXPRESSIONS[:8]], "expression string, plan string")


def explained_predicates(s: SparkSession, d: str) -> DataFrame:
    """A row for each predicate of each expression."""
    rows = [(e, p.mode, i + 1, x["type"], x["value"]) for e in EXPRESSIONS for p in [parse(e)] for i, x in enumerate(p.explain()["predicates"])]
    return s.createDataFrame(rows, "expression string, mode string, place long, type string, value string")


add("explain_plan", explained)
add("explain_predicates", explained_predicates, f"""WITH e(expression) AS (VALUES {', '.join(f"({q(e)})" for e in EXPRESSIONS)}),
m AS (SELECT expression, CASE WHEN contains(expression, '||') THEN 'any' ELSE 'all' END AS mode FROM e),
t AS (SELECT expression, mode, list_filter(list_transform(string_split(trim(expression), CASE mode WHEN 'any' THEN '||' ELSE '&&' END), lambda x: trim(x)), lambda x: x <> '') AS parts FROM m),
p AS (SELECT expression, mode, unnest(parts) AS part, generate_subscripts(parts, 1) AS place FROM t),
k AS (SELECT *, regexp_extract(part, '^(re|prefix|suffix|lit):', 1) AS tag FROM p)
SELECT expression, mode, place, CASE tag WHEN 're' THEN 'regex' WHEN 'lit' THEN 'literal' WHEN '' THEN 'literal' ELSE tag END AS type,
       CASE WHEN tag = '' THEN part ELSE part[length(tag) + 2:] END AS value FROM k""")  # fmt: skip


def entry(s: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["top_hits"](s, sf_dir)
