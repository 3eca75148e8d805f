"""DuckDB SQL for the queries of this subpackage that SQL can express."""

#: The contract's patterns, in full: kind -> (pattern, group, least length of that group), and the method's own opaque runs.
BASE = {
    "assign": (r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": ("(AKIA[A-Z0-9]+)", 1, 20),
    "hex": ("([0-9a-f]{24,})", 1, 24),  # the runs of [0-9a-f]+ that have 24 or more characters; to list all runs first takes minutes
}
OPAQUE = ("([A-Za-z0-9+/_-]{24,})", 1, 24)
KINDS = ["assign", "access", "hex", "opaque"]
#: A live-looking value has one owner and at most two repositories.
MAX_OWNERS, MAX_REPOS = 1, 2

OP1 = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS sha FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size,
  first_value(doc_id) OVER w = doc_id AS kept, sha AS text_sha256
FROM d WINDOW w AS (PARTITION BY sha ORDER BY n DESC, doc_id)
"""


def _spans(kind: str, text: str = "t") -> str:
    """A list of structs (start, kind, end, value) of the matches that pass."""
    pattern, group, least = BASE.get(kind, OPAQUE)
    quoted = pattern.replace("'", "''")
    parts, whole, value = f"regexp_split_to_array({text}, '{quoted}')", f"regexp_extract_all({text}, '{quoted}', 0)", f"regexp_extract_all({text}, '{quoted}', {group})"
    at = f"list_sum([length(g) for g in {parts}[1:i]]) + coalesce(list_sum([length(g) for g in {whole}[1:i - 1]]), 0)"
    ok = f"length(({value})[i]) >= {least}" + (f" AND regexp_matches(({value})[i], '[0-9]') AND regexp_matches(({value})[i], '[A-Za-z]')" if kind == "opaque" else "")
    return f"[{{'start': CAST({at} AS BIGINT), 'kind': {KINDS.index(kind)}, 'end': CAST({at} + length(({whole})[i]) AS BIGINT), 'value': ({value})[i]}} for i in range(1, len({whole}) + 1) if {ok}]"


def _joined(spans: str) -> str:
    return f"array_to_string([{KINDS!r}[x.kind + 1] || ':' || x.start || ':' || x.end for x in {spans}], ',')"


OP2 = f"""
WITH d AS (SELECT doc_id, source, concat_ws('/', source, lang) AS repo, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, source, repo, list_sort(list_concat({", ".join(_spans(k) for k in BASE)})) AS base, {_spans("opaque")} AS opaque FROM d),
a AS (SELECT *, list_concat(base, [o for o in opaque if len([1 for b in base if b.start < o.end AND o.start < b.end]) = 0]) AS every FROM s),
e AS (SELECT doc_id, source, repo, unnest(every) AS x FROM a),
f AS (SELECT x.value AS value, count(DISTINCT coalesce(source, chr(1))) AS owners, count(DISTINCT repo) AS repos FROM e GROUP BY 1),
j AS (SELECT doc_id, x, owners <= {MAX_OWNERS} AND repos <= {MAX_REPOS} AS live FROM e JOIN f ON e.x.value = f.value),
g AS (SELECT doc_id, list_sort(list(x)) AS spans, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_shared FROM j WHERE live OR x.kind < {len(BASE)} GROUP BY 1)
SELECT doc_id, {", ".join(f"len([1 for x in base if x.kind = {i}]) AS n_{k}" for i, k in enumerate(BASE))},
  sha256({_joined("base")}) AS base_sha256, coalesce({_joined("g.spans")}, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_shared, 0) AS n_shared
FROM a LEFT JOIN g USING (doc_id)
"""

_CANON = r"""
regexp_replace(regexp_replace(HOST, '^www\.', ''), ':(80|443)$', '')
|| regexp_replace(regexp_replace(PATH, '/index\.html?$', '/'), '/+$', '')
|| CASE WHEN QUERY = '' THEN '' ELSE '?' || QUERY END
"""
OP4 = r"""
WITH p AS (
  SELECT page_id, url, html, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path,
    array_to_string(list_sort([x for x in string_split(regexp_extract(coalesce(url, ''), '(?s)^[^?#]*\?([^#]*)', 1), '&')
      if x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|sid|sessionid|fbclid|gclid)=')]), '&') AS query
  FROM pages
), c AS (SELECT *, CANON AS canonical FROM p),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
    coalesce(canonical <> '' AND canonical IN (SELECT canonical FROM c WHERE regexp_matches(regexp_extract(html, '<title>([^<]*)', 1), '(!!|\$\$\$|\*\*\*|%%%|;&amp;)')), false) AS listed
  FROM c
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL OR listed THEN 'block' ELSE 'allow' END AS verdict, listed FROM r
""".replace("CANON", _CANON.replace("HOST", "host").replace("PATH", "path").replace("QUERY", "query"))

SQL: dict[str, str] = {"op1_exact_dedup": OP1, "op2_secrets": OP2, "op4_url_filter": OP4}
