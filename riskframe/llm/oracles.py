"""DuckDB SQL for the dealt queries that SQL can state."""

from riskframe.llm.chat import BUDGET, HISTORY, LEAST_SPAN

SIZE = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

OP4 = f"""
WITH d AS (SELECT doc_id, source, CAST({SIZE} AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (
        ORDER BY source_size * 3 / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY source_size * 3 / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
        AS level FROM w),
t AS (SELECT source, source_size, coalesce(least(CAST(source_size * 3 AS DOUBLE),
        CAST(first_value(CASE WHEN level * weight <= source_size * 3 THEN level END IGNORE NULLS) OVER (
          ORDER BY source_size * 3 / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS DOUBLE) * weight), source_size * 3) AS target FROM l),
q AS (SELECT d.*, source_size, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5('42:' || doc_id), doc_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, CAST(target AS DOUBLE) AS target,
  CAST(greatest(0, least(size, floor(target) - before)) + greatest(0, least(size, floor(target) - before - source_size))
     + greatest(0, least(size, floor(target) - before - 2 * source_size)) AS BIGINT) AS taken
FROM q"""

OP7 = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM d"""

_LEN = "length({x}) + 4 * (length({x}) - length(replace({x}, '&', ''))) + 3 * (length({x}) - length(replace({x}, '<', ''))) + 4 * (length({x}) - length(replace({x}, '[', '')))"
OP9 = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
a AS (
  SELECT *, row_number() OVER o AS pos, {SIZE} + 1 AS tokens,
    {_LEN.format(x="role")} + 1 + {_LEN.format(x="text")} + length('<|end|>') + 1 AS body
  FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)),
b AS (
  SELECT *, coalesce(sum(tokens) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
    first_value(CASE WHEN role = 'system' THEN body END) OVER o AS sys_body,
    first_value(CASE WHEN role = 'system' THEN tokens END) OVER o AS sys_tokens,
    lag(tokens, 1) OVER o AS t1, lag(tokens, 2) OVER o AS t2, lag(body, 1) OVER o AS b1, lag(body, 2) OVER o AS b2
  FROM a WINDOW o AS (PARTITION BY conv_id ORDER BY pos)),
e AS (
  SELECT *, greatest({LEAST_SPAN}, {BUDGET - HISTORY} - coalesce(sys_tokens, 0)) AS room,
    CASE WHEN pos - 1 <= CASE WHEN sys_body IS NULL THEN 0 ELSE 1 END OR t1 > {HISTORY} THEN 0
         WHEN pos - 2 <= CASE WHEN sys_body IS NULL THEN 0 ELSE 1 END OR t1 + t2 > {HISTORY} THEN 1 ELSE 2 END AS back FROM b),
f AS (
  SELECT *, start // room AS lo, (start + tokens - 1) // room AS hi,
    CASE WHEN pos > 1 AND sys_body IS NOT NULL THEN 9 + sys_body ELSE 0 END
    + CASE WHEN back >= 1 THEN 9 + b1 ELSE 0 END + CASE WHEN back = 2 THEN 9 + b2 ELSE 0 END AS context FROM e),
g AS (SELECT *, row_number() OVER (PARTITION BY conv_id, lo, hi ORDER BY pos) = 1 AS leads FROM f)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY pos), '')) AS loss_sha256,
  CAST(sum(length('<|turn|>') + body + CASE WHEN leads THEN context ELSE 0 END) AS BIGINT) AS formatted_chars
FROM g GROUP BY conv_id"""

OP1 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM x a JOIN x b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(node, root) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
c AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.root AS component_id, c.root = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.node = d.doc_id"""

OP10 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (SELECT page_id, strlen(html) AS n, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string([array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + ((CAST('0x' || substr(hex, 1 + 5 * i, 5) AS BIGINT) >> (15 - 5 * j)) & 31), 1) FOR j IN range(4)], '') FOR i IN range(8)], '')
    AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM s"""

#: crc32 of a decimal number, bit by bit.
_CRC = """xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST({x} AS VARCHAR), ''),
  lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda r, b: CASE WHEN b >= 0 THEN xor(r, b) ELSE xor(r >> 1, 3988292384 * (r & 1)) END), 4294967295)"""
_TEXT = "coalesce(CAST(strlen(CAST({x} AS VARCHAR)) AS VARCHAR) || ':' || CAST({x} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_TEXT.format(x=c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _tree(name: str, start: str, levels: int) -> str:
    """CTEs of a tree: per level the nodes with the rest of their run, ``start`` at level 0."""
    ctes = [f"{name}0 AS ({start})"]
    for i in range(levels):
        run = f"(PARTITION BY grp, pos // 16 ORDER BY pos ROWS BETWEEN {{}})"
        ctes.append(
            f"{name}s{i} AS (SELECT *, n > 1 AS runs, coalesce(string_agg(node, '') OVER "
            + run.format("UNBOUNDED PRECEDING AND 1 PRECEDING")
            + ", '') AS l, coalesce(string_agg(node, '') OVER "
            + run.format("1 FOLLOWING AND UNBOUNDED FOLLOWING")
            + f", '') AS r FROM {name}{i})"
        )
        ctes.append(
            f"{name}{i + 1} AS (SELECT grp, pos // 16 AS pos, CASE WHEN n > 1 THEN sha256(string_agg(node, '' ORDER BY pos)) "
            f"ELSE min(node) END AS node, (n + 15) // 16 AS n FROM {name}{i} GROUP BY grp, pos // 16, n)"
        )
    return ",\n".join(ctes)


def _manifest(levels: int = 5, upper: int = 3) -> str:
    """Trees of up to 16^levels rows a source and 16^upper sources."""
    steps = [("a", i) for i in range(levels)] + [("b", i) for i in range(upper)]
    folded = "CASE WHEN doc_id IS NOT NULL AND CRC % 5 = 0 THEN changed ELSE leaf END".replace("CRC", _CRC.format(x="doc_id"))
    ctes, last = [], f"SELECT *, {folded} AS f, '' AS proof FROM d"
    for k, (tree, i) in enumerate(steps):
        ctes.append(f"f{k} AS ({last})")
        at = f"x.pos // {16**i} = s.pos AND x.grp = s.grp" if tree == "a" else f"x.gpos // {16**i} = s.pos"
        last = (
            f"SELECT x.* EXCLUDE (f, proof), CASE WHEN s.runs THEN sha256(s.l || x.f || s.r) ELSE x.f END AS f, "
            f"CASE WHEN s.runs THEN x.proof || s.l || s.r ELSE x.proof END AS proof FROM f{k} x JOIN {tree}s{i} s ON {at}"
        )
    below = "SELECT grp, pos, leaf AS node, count(*) OVER (PARTITION BY grp) AS n FROM d0"
    above = f"SELECT 0 AS grp, row_number() OVER (ORDER BY grp) - 1 AS pos, node, count(*) OVER () AS n, grp AS of FROM a{levels}"
    return (
        f"WITH d0 AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM ("
        f"SELECT doc_id, coalesce('s' || source, '-') AS grp, {_leaf('text')} AS leaf, "
        f"{_leaf('translate(text, $$ABCDEFGHIJKLMNOPQRSTUVWXYZ$$, $$abcdefghijklmnopqrstuvwxyz$$)')} AS changed FROM documents)),\n"
        + _tree("a", below, levels)
        + f",\ng AS ({above}),\n"
        + _tree("b", "SELECT grp, pos, node, n FROM g", upper)
        + f",\nd AS (SELECT d0.*, g.pos AS gpos, g.node AS subroot FROM d0 JOIN g ON g.of = d0.grp),\n"
        + ",\n".join(ctes)
        + f",\nz AS ({last})\nSELECT doc_id, leaf, subroot, b.node AS root, sha256(proof) AS proof_sha256, f AS folded_root, "
        f"f = b.node AS verified FROM z, b{upper} b"
    )


OP13 = _manifest()

ORACLES = {
    "op1_minhash": OP1,
    "op10_warc": OP10,
    "op13_merkle": OP13,
    "op4_mixing": OP4,
    "op7_exact_dedup": OP7,
    "op9_chat_formatting": OP9,
}
