"""DuckDB twins of the operators that SQL can express; the others are tested against brute force."""

#: Words: runs of anything but the blank and 9 to 13.
_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS hex, min(page_id) OVER (PARTITION BY sha1(h)) AS first FROM p),
g AS (SELECT *, list_transform(range(0, 8), lambda k: ('0x' || substr(hex, k::INT * 5 + 1, 5))::BIGINT) AS v FROM d)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v[(j // 4 + 1)::INT] >> (15 - 5 * (j % 4))::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM g"""

SUBSTRING = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS p, w FROM d WHERE len(w) >= 20),
s AS (SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS x FROM win),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY x ORDER BY doc_id, p) AS r FROM s) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM again),
lost AS (SELECT doc_id, list(i) AS lost FROM gone GROUP BY doc_id),
k AS (SELECT doc_id, w, coalesce(lost, []) AS lost FROM d LEFT JOIN lost USING (doc_id))
SELECT doc_id, len(w)::BIGINT AS n_words, len(lost)::BIGINT AS n_removed,
  sha256(CASE WHEN len(lost) = 0 THEN array_to_string(w, ' ') ELSE array_to_string([w[i] FOR i IN range(1, len(w) + 1) IF NOT list_contains(lost, i)], ' ') END) AS kept_sha256
FROM k"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = "list_filter(regexp_split_to_array(" + _LOWER.format("coalesce(text, '')") + ", '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"

DECONTAMINATION = f"""
WITH b AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS x FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS x FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, n, p FROM dw JOIN iw USING (n, x)),
words AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS i FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, coalesce(item_id::VARCHAR, '') AS id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


def _codes(rounds: int = 4, entries: int = 256, parts: int = 4) -> str:
    """Integer parts, unrolled rounds of assigning and averaging, and a last assignment."""
    own = "list_filter(list_transform(coalesce(embedding, []), lambda v: CASE WHEN isfinite(v) THEN floor(1024 * v::DOUBLE)::BIGINT END), lambda v: v IS NOT NULL)"
    steps = [
        f"good AS (SELECT row_number() OVER () AS r, vec_id, label, {own} AS x FROM embeddings WHERE embedding IS NOT NULL AND len({own}) = len(embedding) AND len(embedding) > 0 AND len(embedding) % {parts} = 0)",
        "long AS (SELECT len(x) AS n FROM good GROUP BY n ORDER BY count(*) DESC, n LIMIT 1)",
        "v AS MATERIALIZED (SELECT r, vec_id, label, x FROM good, long WHERE len(x) = n)",
        f"p AS MATERIALIZED (SELECT r, k, x[k * (len(x) // {parts}) + 1:(k + 1) * (len(x) // {parts})] AS x FROM v, (SELECT unnest(range(0, {parts}))::INT AS k))",
        f"first AS (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS e FROM v ORDER BY e LIMIT {entries})",
        "b0 AS MATERIALIZED (SELECT k, e, x AS c FROM p JOIN first USING (r))",
    ]
    near = "a{0} AS MATERIALIZED (SELECT r, k, min(struct_pack(d := d, e := e)) AS m FROM (SELECT r, p.k, e, list_sum(list_transform(list_zip(x, c), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::BIGINT AS d FROM p JOIN b{0} USING (k)) GROUP BY r, k)"
    for j in range(rounds):
        steps += [
            near.format(j),
            f"u{j} AS (SELECT k, e, list(s ORDER BY i) AS c FROM (SELECT k, m.e AS e, i, (sum(y) // count(*) - (sum(y) % count(*) < 0)::INT)::BIGINT AS s FROM (SELECT k, m, unnest(x) AS y, unnest(range(1, len(x) + 1)) AS i FROM a{j} JOIN p USING (r, k)) GROUP BY k, m.e, i) GROUP BY k, e)",
            f"b{j + 1} AS MATERIALIZED (SELECT b{j}.k, b{j}.e, coalesce(u{j}.c, b{j}.c) AS c FROM b{j} LEFT JOIN u{j} USING (k, e))",
        ]
    steps += [
        near.format(rounds),
        f"coded AS (SELECT r, string_agg(lpad(lower(to_hex(m.e)), 2, '0'), '' ORDER BY k) AS code, sum(m.d)::BIGINT AS error FROM a{rounds} GROUP BY r)",
        f"book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY k, e)) AS h FROM b{rounds})",
    ]
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM coded JOIN v USING (r), book"


CODES = _codes()

#: The driver's DuckDB may lack a CRC-32: the table by its rule, then one step for each (ASCII) character.
_CRC = (
    "(SELECT list(list_reduce(range(0, 8), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS t FROM (SELECT unnest(range(0, 256)) AS b))"
)


def _repair() -> str:
    """A forward DP over states (nothing, s, u, a), each the least (cost, audit) with the repaired lines."""
    roles = {1: "s", 2: "u", 3: "a"}
    gap = {(0, 1): 0, (0, 2): 0, (0, 3): 1, (1, 2): 0, (1, 3): 1, (2, 2): 1, (2, 3): 0, (3, 2): 0, (3, 3): 1}
    into = []
    for to in range(4):
        ways = [f"struct_pack(c := d[{to + 1}].c + 2, a := d[{to + 1}].a || 'D', t := d[{to + 1}].t)"]
        for (state, role), g in gap.items():
            if role != to:
                continue
            other = "assistant" if role == 2 else "user"
            lines = f"list_concat(d[{state + 1}].t, {f'[{other + chr(58)!r}]' if g else '[]::VARCHAR[]'})"
            own, name = f"x.i = '{roles[role]}'", {2: "user", 3: "assistant"}.get(role, "")
            change = "NULL" if role == 1 else f"struct_pack(c := d[{state + 1}].c + {5 * g + 1} + x.more, a := d[{state + 1}].a || '{'I' * g}R', t := list_append({lines}, '{name}:' || x.text))"
            ways.append(f"CASE WHEN x.must THEN NULL WHEN {own} THEN struct_pack(c := d[{state + 1}].c + {5 * g} + x.more, a := d[{state + 1}].a || '{'I' * g}K', t := list_append({lines}, x.role || ':' || x.text)) ELSE {change} END")
        into.append(f"list_min([{', '.join(ways)}])")
    first = "[struct_pack(c := 0::BIGINT, a := '', t := []::VARCHAR[])" + ", struct_pack(c := 1000000000::BIGINT, a := '', t := []::VARCHAR[])" * 3 + "]"
    ends = ["d[1]", "struct_pack(c := d[2].c + 10, a := d[2].a || 'II', t := list_concat(d[2].t, ['user:', 'assistant:']))", "struct_pack(c := d[3].c + 5, a := d[3].a || 'I', t := list_append(d[3].t, 'assistant:'))", "d[4]"]
    key = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
    return f"""
WITH crc AS {_CRC},
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_reduce(list_transform(string_split({key}, ''), lambda c: ascii(c)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295) AS crc FROM conversations, crc),
dam AS (SELECT conv_id, turn, xor(crc, 4294967295) % 20 AS kind, role, text FROM k),
rows AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM dam, range(0, 2) AS r(c) WHERE kind <> 0 AND (c = 0 OR kind = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS n FROM rows),
f AS (SELECT conv_id, turn, role, text, n, left(role, 1) AS i, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again, NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS cut, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM o),
g AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (cut AND NOT blank AND NOT again) AS truncated,
  count(*) FILTER (n > 1 AND before || i NOT IN ('su', 'ua', 'au')) AS illegal,
  list(struct_pack(i := i, must := blank OR again, more := CASE WHEN cut THEN 5 ELSE 0 END, role := role, text := text) ORDER BY n) AS x FROM f GROUP BY conv_id),
s AS (SELECT * EXCLUDE (x), list_reduce(list_concat([struct_pack(d := {first}, x := NULL::STRUCT(i VARCHAR, must BOOLEAN, more INTEGER, role VARCHAR, text VARCHAR))], list_transform(x, lambda y: struct_pack(d := {first}, x := y))),
  lambda p, q: struct_pack(d := (list_transform([struct_pack(d := p.d, x := q.x)], lambda z: [{', '.join(w.replace('d[', 'z.d[').replace('x.', 'z.x.') for w in into)}]))[1], x := q.x)).d AS d FROM g),
e AS (SELECT * EXCLUDE (d), list_min([{', '.join(ends)}]) AS m FROM s)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(m.c, 0)::BIGINT AS cost, coalesce(m.a, '') AS audit, sha256(coalesce(array_to_string(m.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN e ON c.conv_id IS NOT DISTINCT FROM e.conv_id"""


REPAIR = _repair()

_ESCAPED = r"length(regexp_replace({}, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g'))"

CHAT = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, n, CASE n WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(0, 2) AS r(n)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS n, 17 + {_ESCAPED.format('role')} + {_ESCAPED.format('text')} AS chars FROM c),
s AS (SELECT *, 3 + sum(chars) OVER (PARTITION BY conv_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS upto, max(n) OVER (PARTITION BY conv_id) AS turns FROM o)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  coalesce(sum(upto) FILTER (role = 'assistant' OR n = turns), 0)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id"""
