"""DuckDB SQL for the queries that SQL can express: whole tables, windows and shingles as rows, closures by recursion."""

from __future__ import annotations

from .mixing import MIX_SQL

_WORDS = r"""words AS (SELECT doc_id, regexp_extract_all({text}, '[^\x20\x09-\x0D]+') AS w FROM documents)"""
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DUPS = f"""WITH RECURSIVE {_WORDS.format(text=_LOWER)},
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, l.b FROM reach r JOIN both_ways l ON r.v = l.a),
least_of AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM documents d JOIN least_of c ON d.doc_id = c.u LEFT JOIN sizes s ON s.doc_id = d.doc_id"""

SUBSTRINGS = f"""WITH {_WORDS.format(text="coalesce(text, '')")},
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words WHERE len(w) >= 50)),
first_of AS (SELECT g, min(doc_id) AS low FROM windows GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM windows JOIN first_of USING (g) WHERE low < doc_id),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM words WHERE len(w) > 0),
kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.j) AS t FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.j = g.j WHERE g.j IS NULL GROUP BY e.doc_id),
counted AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256 FROM words w LEFT JOIN kept k ON w.doc_id = k.doc_id LEFT JOIN counted c ON w.doc_id = c.doc_id"""

_ESCAPED = r"len(regexp_extract_all({0}, '\\|<s>|</s>|\[INST\]|\[/INST\]')) + length({0})"
CHAT = f"""WITH told AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
joined AS (SELECT conv_id, count(*) AS n_turns, string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text) AS t,
  coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '') AS l, sum(17 + {_ESCAPED.format('role')} + {_ESCAPED.format('text')}) AS f FROM told GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(t) AS turns_sha256, length(l)::BIGINT AS loss_chars, sha256(l) AS loss_sha256, (f + 3)::BIGINT AS formatted_chars FROM joined"""

SQL = {
    "op2_near_dups": NEAR_DUPS,
    "op6_substrings": SUBSTRINGS,
    "op7_chat": CHAT,
    "op10_mixing": "WITH " + MIX_SQL.format(docs="documents") + " SELECT doc_id, size, source_size, target, copies * size AS taken FROM mixed",
}
