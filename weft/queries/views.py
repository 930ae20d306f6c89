"""The evidence views of ``weft.sources.tables`` as SQL common table expressions."""

from ..functions.lexicons import STOPWORDS
from ..sources.tables import CODEBOOK, DAYS, TURNS


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


STOP = quoted(STOPWORDS)

ORDERS = """
st AS (SELECT o_orderkey AS study_id, o_orderkey AS ord, year(o_orderdate) AS year,
  CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 'high' WHEN o_orderpriority[1] = '3' THEN 'moderate'
       WHEN o_orderpriority[1] = '5' THEN 'low' ELSE 'unclear' END AS quality FROM orders),
ts AS (SELECT DISTINCT p_brand AS theme_id, l_orderkey AS study_id FROM lineitem JOIN part ON l_partkey = p_partkey),
th AS (SELECT DISTINCT p_brand AS theme_id, CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS BIGINT) AS ord FROM part)
"""

CUSTOMERS = """
st AS (SELECT c_custkey AS study_id, c_custkey AS ord, 2000 + c_custkey % 10 AS year FROM customer),
th AS (SELECT n_name AS theme_id, CAST(n_nationkey AS BIGINT) AS ord, r_name AS parent_id
         FROM nation JOIN region ON n_regionkey = r_regionkey
       UNION ALL SELECT r_name, 1000 + r_regionkey, 'WORLD' FROM region
       UNION ALL SELECT 'WORLD', 2000, NULL),
ts AS (SELECT unnest([n_name, r_name, 'WORLD']) AS theme_id, c_custkey AS study_id
         FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""

EVENTS = f"""
ev AS (SELECT user_id * {DAYS} + epoch(ts)::BIGINT // 86400 AS study_id, printf('K%02d', CAST(json_extract_string(props, '$.k') AS BIGINT) % 12) AS theme_id FROM events),
st AS (SELECT DISTINCT study_id, study_id AS ord FROM ev),
th AS (SELECT DISTINCT printf('K%02d', CAST(json_extract_string(props, '$.k') AS BIGINT) % 12) AS theme_id FROM events),
ts AS (SELECT DISTINCT theme_id, study_id FROM ev)
"""

_N = len(CODEBOOK)
_ROWS = ", ".join(
    "('{}', {}, '{}', [{}]::VARCHAR[], '{}', {})".format(
        t, i, label, quoted(concepts), level, f"'{parent}'" if parent else "NULL")
    for i, (t, label, concepts, level, parent) in enumerate(CODEBOOK))

DOCS = f"""
st AS (SELECT documents.doc_id AS study_id, documents.doc_id AS ord, 2000 + documents.doc_id % 20 AS year,
   CASE quality WHEN 1 THEN 'high' WHEN 0 THEN 'low' ELSE 'moderate' END AS quality,
   text FROM documents LEFT JOIN labels ON labels.doc_id = documents.doc_id),
th(theme_id, ord, label, concepts, level, parent_id) AS (VALUES {_ROWS}),
src AS (SELECT doc_id, CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) AS k FROM documents),
ts AS (SELECT 'T' || (k % {_N}) AS theme_id, doc_id AS study_id FROM src
       UNION ALL SELECT 'T' || ((k + 1) % {_N}), doc_id FROM src WHERE k % 4 = 0
       UNION ALL SELECT 'T' || ((k + 3) % {_N}), doc_id FROM src WHERE k % 5 = 0),
quotes AS (SELECT conv_id AS study_id, conv_id || '-' || turn AS quote_id, turn, text FROM conversations),
tq AS (SELECT DISTINCT 'T' || ((conv_id + turn) % {_N - 2}) AS theme_id, conv_id || '-' || turn AS quote_id
       FROM conversations),
lines AS (SELECT doc_id AS study_id, unnest(string_split(text, chr(10))) AS text,
            unnest(range(len(string_split(text, chr(10))))) AS part FROM documents),
parts AS (SELECT study_id, part, text FROM lines
          UNION ALL SELECT study_id, turn + {TURNS}, text FROM quotes)
"""


def tokens(expr: str) -> str:
    """SQL list of the kept tokens of a text expression."""
    return (f"list_filter(regexp_split_to_array(lower({expr}), '[^a-zA-Z]+'), "
            f"lambda t: length(t) > 1 AND t NOT IN ({STOP}))")


def raw_tokens(expr: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({expr}), '[^a-zA-Z]+'), lambda t: length(t) > 0)"


def r6(expr: str) -> str:
    return f"(round({expr}, 6) + 0.0::DOUBLE)"
