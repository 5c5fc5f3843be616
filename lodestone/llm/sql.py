"""DuckDB SQL of operators whose definitions need a CRC-32, which DuckDB hasn't: it is worked out byte by byte."""

from __future__ import annotations

#: The table of the CRC's bytes, by its rule, as one row with the list t.
CRC_TABLE = "crc AS MATERIALIZED (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"


def crc32(text: str) -> str:
    """Of a text's UTF-8; the table's list t must be in scope."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex({text}), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


#: Transactions by windows: a rollback at some depth of savepoints undoes the changes at that depth before it that are still there.
LOG_REASSEMBLY = f"""
WITH {CRC_TABLE},
hashed AS (SELECT doc_id, coalesce('=' || source, '') AS s, text, {crc32("doc_id::VARCHAR")} AS h FROM documents, crc WHERE doc_id IS NOT NULL),
toxic AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
log AS (SELECT doc_id, s, text, h // 100 % 300 AS key, CASE WHEN h % 23 < 2 THEN 'commit' WHEN h % 23 = 2 THEN 'abort' WHEN h % 23 < 5 THEN 'savepoint' WHEN h % 23 < 7 THEN 'rollback' ELSE 'change' END AS kind FROM hashed),
numbered AS (SELECT *, count(*) FILTER (WHERE kind IN ('commit', 'abort')) OVER (PARTITION BY s ORDER BY doc_id) - (kind IN ('commit', 'abort'))::INT AS txn FROM log),
moved AS (SELECT *, sum(CASE kind WHEN 'savepoint' THEN 1 WHEN 'rollback' THEN -1 ELSE 0 END) OVER (PARTITION BY s, txn ORDER BY doc_id) AS run FROM numbered),
depths AS (SELECT *, run - least(0, min(run) OVER (PARTITION BY s, txn ORDER BY doc_id)) AS depth FROM moved),
levels AS (SELECT *, CASE WHEN kind = 'rollback' THEN coalesce(lag(depth) OVER (PARTITION BY s, txn ORDER BY doc_id), 0) ELSE depth END AS level,
    max(CASE WHEN kind IN ('commit', 'abort') THEN doc_id END) OVER (PARTITION BY s, txn) AS ended, max(CASE WHEN kind IN ('commit', 'abort') THEN kind END) OVER (PARTITION BY s, txn) AS ending FROM depths),
fates AS (SELECT *, min(CASE WHEN kind = 'rollback' THEN doc_id END) OVER (PARTITION BY s, txn, level ORDER BY doc_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS undo FROM levels),
changes AS (SELECT *, CASE WHEN undo IS NOT NULL THEN 'rollback' WHEN ending = 'commit' THEN 'commit' ELSE 'abort' END AS fate FROM fates WHERE kind = 'change'),
commits AS (SELECT doc_id AS ended, (row_number() OVER (ORDER BY doc_id) + 3) // 4 AS epoch FROM log WHERE kind = 'commit'),
values_ AS (SELECT key, epoch, ended, doc_id, CASE WHEN text IS NULL OR doc_id IN (SELECT doc_id FROM toxic) THEN NULL ELSE {crc32("key || ':' || text")} END AS v FROM changes JOIN commits USING (ended), crc WHERE fate = 'commit'),
last AS (SELECT key, epoch, v FROM values_ QUALIFY row_number() OVER (PARTITION BY key, epoch ORDER BY ended DESC, doc_id DESC) = 1),
deltas AS (SELECT epoch, (v IS NOT NULL)::INT - (lag(v) OVER (PARTITION BY key ORDER BY epoch) IS NOT NULL)::INT AS n, coalesce(v, 0) - coalesce(lag(v) OVER (PARTITION BY key ORDER BY epoch), 0) AS d FROM last),
epochs AS (SELECT e.epoch, coalesce(sum(n), 0) AS n, coalesce(sum(d), 0) AS d FROM (SELECT DISTINCT epoch FROM commits) e LEFT JOIN deltas USING (epoch) GROUP BY e.epoch)
SELECT 'state' AS kind, epoch AS id, (sum(n) OVER (ORDER BY epoch))::BIGINT AS n, (sum(d) OVER (ORDER BY epoch))::BIGINT AS value FROM epochs
UNION ALL SELECT fate, doc_id, coalesce(undo, ended), key FROM changes WHERE fate <> 'commit'"""

#: Near words by the words that are left without one letter: of equal length without the same one, or one is the other without one.
SPELLING_VARIANTS = f"""
WITH {CRC_TABLE},
runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT *, {crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM runs, crc),
cut AS (SELECT n, CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
less AS MATERIALIZED (SELECT word, n, i, left(word, (i - 1)::INT) AS head, substr(word, (i + 1)::INT) AS tail FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM less a JOIN less b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
    UNION SELECT less.word, words.word, words.n FROM less JOIN words ON words.word = head || tail
    UNION SELECT words.word, less.word, less.n FROM less JOIN words ON words.word = head || tail),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY word),
formed AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN other END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM words LEFT JOIN best USING (word)),
chain AS (WITH RECURSIVE c AS (SELECT word, word AS root FROM formed UNION SELECT c.word, f.form FROM c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL) SELECT * FROM c),
ends AS (SELECT chain.word, root FROM chain JOIN formed ON formed.word = root WHERE form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)"""
