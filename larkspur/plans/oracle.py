"""DuckDB SQL for the registered queries, written for itself over the raw tables."""

from __future__ import annotations

BASE, HOUR = 1_704_067_200_000, 3_600_000
NOW = BASE + 60 * HOUR
UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def low(x: str) -> str:
    return f"translate({x}, '{UP}', '{LOW}')"


CHAT = f"""
turns AS (
  SELECT *, lag(turn) OVER w AS p1, lead(turn) OVER w AS n1, lag(turn, 2) OVER w AS p2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
),
chat AS (
  SELECT 'conv-' || conv_id || '-' || turn AS id, 'acme' AS tenant_id, 'chat' AS namespace, 'u' || (conv_id % 10) AS actor_id, 'c' || conv_id AS conversation_id, 's' || (conv_id % 3) AS session_id,
    role AS source, ['chat', role] AS labels, CASE role WHEN 'system' THEN 'Verified' WHEN 'user' THEN 'Observed' ELSE 'Derived' END AS trust_level, 'Episodic' AS kind, coalesce(text, '') AS content, CAST(NULL AS VARCHAR) AS summary,
    CASE WHEN turn % 7 = 6 THEN 'Draft' WHEN conv_id % 17 = 3 AND turn = 1 THEN 'Archived' ELSE 'Active' END AS quality_state, {BASE} + conv_id * {HOUR} + turn * 60000 AS updated_at, {BASE} + conv_id * {HOUR} + turn * 60000 - conv_id % 5 * 12 * {HOUR} AS created_at,
    CASE WHEN conv_id % 13 = 0 THEN {BASE} + conv_id * {HOUR} + turn * 60000 + 10 * {HOUR} END AS expires_at, (turn % 5) / 5.0::DOUBLE AS importance,
    'c' || conv_id AS ep_id, ['Open', 'Resolved', 'Superseded', 'Abandoned'][1 + conv_id % 4] AS ep_state, 'answer ' || role AS ep_goal, {BASE} + conv_id * {HOUR} AS started, {BASE} + conv_id * {HOUR} + turn * 60000 AS last_active,
    CASE WHEN conv_id % 5 = 0 THEN 'weekly' END AS rec_key, CASE WHEN conv_id % 5 = 0 THEN 604800000 END AS rec_ms, CASE WHEN turn = 0 THEN 'handoff' END AS boundary,
    'conv-' || conv_id || '-' || p1 AS prev, 'conv-' || conv_id || '-' || n1 AS next, CASE WHEN p2 IS NULL THEN [] ELSE ['conv-' || conv_id || '-' || p2] END AS causal,
    CASE WHEN turn = 0 AND conv_id > 0 THEN ['conv-' || (conv_id - 1) || '-0'] ELSE [] END AS related, turn AS reuse, (conv_id % 10) / 10.0::DOUBLE AS novelty,
    CASE WHEN conv_id % 11 = 0 AND turn = 1 THEN 'Superseded' WHEN conv_id % 7 = 0 AND turn = 2 THEN 'Historical' ELSE 'Current' END AS historical,
    CASE WHEN turn = 1 THEN ['conv-' || conv_id || '-0'] ELSE [] END AS lineage_ids,
    CASE WHEN turn = 2 THEN ['None', 'PotentialConflict', 'UnderReview', 'Resolved', 'Dismissed'][1 + conv_id % 5] END AS conf_state, CASE WHEN turn = 2 THEN CASE WHEN conv_id % 5 >= 3 THEN 'Accepted' ELSE 'None' END END AS conf_res,
    CASE WHEN turn = 2 THEN ['conv-' || conv_id || '-' || (turn - 1)] ELSE [] END AS conf_ids
  FROM turns
)"""

DOCS = f"""
docs AS (
  SELECT 'doc-' || d.doc_id AS id, 'acme' AS tenant_id, coalesce(lang, 'und') AS namespace, coalesce(source, 'unknown') AS actor_id, coalesce(source, 'unknown') AS source, ['doc', coalesce(lang, 'und')] AS labels,
    CASE quality WHEN 1 THEN 'Verified' WHEN 0 THEN 'Untrusted' ELSE 'Derived' END AS trust_level, 'Fact' AS kind, coalesce(text, '') AS content, CASE WHEN toxic = 1 THEN 'Suppressed' ELSE 'Active' END AS quality_state,
    {BASE} + d.doc_id * 60000 AS updated_at, {BASE} + d.doc_id * 60000 AS created_at, least(1.0, n_chars / 20000.0::DOUBLE) AS importance, 'Current' AS historical
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""

EVENTS = """
evts AS (
  SELECT 'evt-' || event_id AS id, 'acme' AS tenant_id, 'events' AS namespace, 'u' || user_id AS actor_id, event_type AS source, event_type || ' ' || coalesce(props, '') AS content, epoch_ms(ts) AS updated_at,
    coalesce(least(1.0, greatest(0.0, value / 500)), 0.0) AS importance, 'u' || user_id AS ep_id, CASE WHEN event_type = 'error' THEN 'Open' ELSE 'Resolved' END AS ep_state,
    'evt-' || lag(event_id) OVER w AS prev, 'evt-' || lead(event_id) OVER w AS next
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
)"""

#: Who may be seen by default: not expired, current, and not archived, suppressed or deleted.
SEEN = f"(expires_at IS NULL OR expires_at > {NOW}) AND historical = 'Current' AND quality_state NOT IN ('Archived', 'Suppressed', 'Deleted')"
ALIVE = "quality_state IN ('Draft', 'Active', 'Verified')"


def ids(where: str, alive: bool = True) -> str:
    """id of the chat records of actor u3 that pass where."""
    return f"WITH {CHAT} SELECT id FROM chat WHERE actor_id = 'u3' AND {where}" + (f" AND {SEEN}" if alive else f" AND (expires_at IS NULL OR expires_at > {NOW})")


SALIENCE = "(least(reuse, 10) / 10.0 * 0.35 + novelty * 0.15 + 0.5 * 0.35 + 0.25 * 0.25 + 0.2 * 0.1 + 0.1 * 0.05)"
EP_HAY = low("concat_ws(' ', '', coalesce(ep_goal, ''), '', actor_id, coalesce(rec_key, ''), coalesce(boundary, ''), array_to_string(related, ' '), '')")


def trust_case(w: dict, column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in w.items()) + " ELSE 0 END"


# The policy profile General; and the others for the sweep over five profiles.
PROFILES = {
    "General": ((0.14, 0.09, 0.03, 0.0, -0.08), (0.08, 0.03, -0.03, -0.08, -0.20, -0.30), (0.06, -0.05, -0.12), 0.12),
    "Support": ((0.20, 0.13, 0.01, -0.03, -0.14), (0.12, 0.05, -0.06, -0.12, -0.28, -0.40), (0.09, -0.09, -0.16), 0.16),
    "Research": ((0.10, 0.07, 0.04, 0.03, -0.04), (0.05, 0.02, -0.01, -0.02, -0.12, -0.18), (0.03, -0.01, -0.04), 0.04),
    "Assistant": ((0.13, 0.10, 0.03, 0.01, -0.07), (0.09, 0.04, -0.03, -0.06, -0.18, -0.28), (0.07, -0.03, -0.10), 0.10),
    "AutonomousAgent": ((0.18, 0.12, 0.02, 0.0, -0.10), (0.10, 0.05, -0.04, -0.08, -0.24, -0.36), (0.08, -0.06, -0.14), 0.14),
}


# Weights of archived, historical and superseded records where a query asks for history, under continuity-aware planning.
ASKED = {"General": (-0.02, 0.04, -0.02), "Support": (-0.05, 0.01, -0.05), "Research": (0.01, 0.08, 0.02), "Assistant": (-0.01, 0.04, -0.01), "AutonomousAgent": (-0.02, 0.03, -0.03)}


def delta(profile: str = "General", source: str = "user", asked: bool = False) -> str:
    trust, state, history, own = PROFILES[profile]
    if asked:
        state, history = (*state[:3], ASKED[profile][0], *state[4:]), (history[0], *ASKED[profile][1:])
    return (
        f"(CASE WHEN source = '{source}' THEN {own} ELSE 0 END + {trust_case(dict(zip(('Pinned', 'Verified', 'Observed', 'Derived', 'Untrusted'), trust)), 'trust_level')}"
        f" + {trust_case(dict(zip(('Verified', 'Active', 'Draft', 'Archived', 'Suppressed', 'Deleted'), state)), 'quality_state')} + {trust_case(dict(zip(('Current', 'Historical', 'Superseded'), history)), 'historical')})"
    )


CURATION = "(" + trust_case({"Pinned": 0.45, "Verified": 0.25, "Observed": 0.10, "Derived": 0.05, "Untrusted": -0.10}, "trust_level") + " + " + trust_case({"Verified": 0.20, "Draft": -0.05, "Archived": -0.15, "Suppressed": -0.40, "Deleted": -0.50}, "quality_state") + ")"


def scored(
    terms: list[str], weights=(1.0, 1.0), curated: bool = False, bonus: str = "0.0", where: str = "actor_id = 'u3'", frm: str = "chat", source: str = "user", more: str = "0.0", episodes: bool = True, name: str = "scored", semantic: str = "0.0"
) -> str:
    """Records of frm with score parts; weights are of lexical and policy, bonus goes to temporal and more to episodic scores."""
    hay = f"{low('content')} || ' ' || {low(chr(99) + 'oalesce(summary, ' + chr(39) * 2 + ')')}" + (f" || ' ' || {low('source')}" if curated else "")
    has = lambda h: " + ".join(f"contains({h}, '{t}')::INT" for t in terms)
    hit = lambda h: " OR ".join(f"contains({h}, '{t}')" for t in terms)
    by_source = f"0.5 * ({has(low('source'))})" if curated else f"CASE WHEN {hit(low('source'))} THEN 0.5 ELSE 0 END"
    days = 30 if curated else 7
    policy = f"greatest(0, importance + {CURATION})" if curated else "importance"
    of_episode = f"0.2 * ({has(EP_HAY)}) + {more}" if episodes else "0.0"
    return f"""
{name} AS (
  SELECT *, lexical * {weights[0]} + semantic * 0.45 + metadata * {0.45 if curated else 0.4} + temporal * 0.2 + episodic * 0.35 + salience * 0.25 + {"curation * 0.5 + " if curated else ""}plain * {weights[1]} + delta AS total,
    CASE WHEN delta <> 0 THEN greatest(0, plain + delta) ELSE plain END AS policy
  FROM (SELECT *, {has("(" + hay + ")")} AS lexical, {semantic} AS semantic, len(list_filter(labels, lambda x: {hit(low("x"))})) + {by_source} AS metadata,
      1 - least(greatest({NOW} - updated_at, 0), {days * 86400000}) / {days * 86400000}.0::DOUBLE + {bonus} AS temporal, {of_episode} AS episodic, {SALIENCE if episodes else "0.0"} AS salience,
      {CURATION if curated else "0.0"} AS curation, {policy} AS plain, {delta(source=source)} AS delta FROM {frm} WHERE {where} AND {SEEN})
  WHERE lexical > 0
)"""


def r6(*names: str) -> str:
    return ", ".join(f"round(CAST({n} AS DOUBLE), 6) AS {n}" for n in names)


TERMS = ["the", "answer", "user", "que"]
TOP = "SELECT id, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS rank, round(CAST(total AS DOUBLE), 6) AS total FROM scored QUALIFY rank <= 10"
BLANK = f"""
scored AS (
  SELECT *, 1 + 0.25 * {SALIENCE} + importance + {delta()} AS total FROM chat WHERE actor_id = 'u3' AND {SEEN}
)"""

EDGES = """
edges AS (
  SELECT id AS src, 'episode:' || ep_id AS dst, 'EpisodeMembership' AS kind, 'continuity_state=' || ep_state AS details FROM shown
  UNION ALL SELECT id, prev, 'ChronologyPrevious', '' FROM shown WHERE prev IS NOT NULL
  UNION ALL SELECT id, next, 'ChronologyNext', '' FROM shown WHERE next IS NOT NULL
  UNION ALL SELECT id, unnest(causal), 'Causal', '' FROM shown
  UNION ALL SELECT id, unnest(related), 'Related', '' FROM shown
  UNION ALL SELECT id, unnest(lineage_ids), 'Lineage', 'relation=DerivedFrom;confidence_per_mille=800' FROM shown
  UNION ALL SELECT id, unnest(conf_ids), 'Conflict', 'state=' || conf_state || ';resolution=' || conf_res FROM shown
)"""


KINDS = ("episode", "chronology", "causal", "related", "lineage")


def hop_rows(n: int) -> str:
    """hop1 .. hopn: expansion from found0 over kept."""
    out = """
rel AS (
  SELECT DISTINCT * FROM (SELECT id, 'episode' AS r, 'episode:' || ep_id AS target FROM kept UNION ALL SELECT id, 'chronology', prev FROM kept WHERE prev IS NOT NULL UNION ALL SELECT id, 'chronology', next FROM kept WHERE next IS NOT NULL
  UNION ALL SELECT id, 'causal', unnest(causal) FROM kept UNION ALL SELECT id, 'related', unnest(related) FROM kept UNION ALL SELECT id, 'lineage', unnest(lineage_ids) FROM kept)
)"""
    for h in range(1, n + 1):
        front = "found0" if h == 1 else f"hop{h - 1}"
        before = "SELECT id FROM found0" + "".join(f" UNION ALL SELECT id FROM hop{k}" for k in range(1, h))
        kinds = ", ".join(f"CASE WHEN bool_or(r = '{k}') THEN 'graph_relation={k}' END" for k in KINDS)
        out += f""",
hop{h} AS (
  SELECT id, max(CASE r WHEN 'episode' THEN 0.45 WHEN 'chronology' THEN 0.35 WHEN 'causal' THEN 0.32 WHEN 'lineage' THEN 0.28 ELSE 0.24 END) + 0.04 * (count(DISTINCT r) - 1) - 0.08 * {h - 1} AS graph, {h} AS hop,
    array_to_string(list_filter([{kinds}, 'graph_hop={h}'], lambda x: x IS NOT NULL), ',') AS relation_reasons
  FROM rel WHERE target IN (SELECT id FROM {front} UNION ALL SELECT 'episode:' || k.ep_id FROM kept k JOIN {front} f USING (id)) AND id NOT IN ({before}) GROUP BY id
)"""
    return out


def hops(n: int) -> str:
    """Expansion from the first turns of two conversations over all current chat records."""
    out = f"""
kept AS (SELECT * FROM chat WHERE historical = 'Current'),
found0 AS (SELECT id FROM kept WHERE conversation_id IN ('c3', 'c13') AND reuse = 0),{hop_rows(n)}"""
    return out + "\n" + " UNION ALL ".join(f"SELECT id, round(CAST(graph AS DOUBLE), 6) AS graph, CAST(hop AS INTEGER) AS hop, relation_reasons FROM hop{h}" for h in range(1, n + 1))


LED = ["what", "led", "to", "the", "answer"]
#: A continuity question of u3 over unresolved episodes: seeds, two hops, and all candidates with where they come from.
CONTINUITY = f"""
kept AS (SELECT * FROM chat WHERE actor_id = 'u3' AND ep_state IN ('Open', 'Abandoned') AND {SEEN}),
{scored(LED, frm="kept", more="0.35 + CASE WHEN len(causal) > 0 THEN 0.25 ELSE 0 END", where="true").strip()},
found0 AS (SELECT id FROM scored),{hop_rows(2)},
later AS (
  SELECT k.*, h.graph, h.relation_reasons, 1 - least(greatest({NOW} - updated_at, 0), 604800000) / 604800000.0::DOUBLE AS temporal, 0.2 * ({" + ".join(f"contains({EP_HAY}, '{t}')::INT" for t in LED)}) + 0.35 + CASE WHEN len(causal) > 0 THEN 0.25 ELSE 0 END AS episodic,
    {SALIENCE} AS salience, greatest(0, importance + {delta()}) AS policy FROM kept k JOIN (SELECT id, graph, relation_reasons FROM hop1 UNION ALL SELECT id, graph, relation_reasons FROM hop2) h USING (id)
),
every AS (
  SELECT id, 'CandidateGeneration' AS planner_stage, array_to_string(list_filter(['Lexical', CASE WHEN metadata > 0 THEN 'Metadata' END, 'Episode', CASE WHEN temporal > 0 THEN 'Temporal' END, CASE WHEN delta <> 0 THEN 'Provenance' END], lambda x: x IS NOT NULL), ',') AS candidate_sources,
    '' AS relation_reasons, 0.0 AS graph, total FROM scored
  UNION ALL SELECT id, 'GraphExpansion', array_to_string(list_filter(['Episode', 'Graph', CASE WHEN temporal > 0 THEN 'Temporal' END, CASE WHEN {delta()} <> 0 THEN 'Provenance' END], lambda x: x IS NOT NULL), ','), relation_reasons, graph,
    graph + temporal * 0.15 + episodic * 0.35 + salience * 0.25 + policy * 0.5 FROM later
)"""

HEXES = "0123456789ABCDEF"


def embedded(src: str, dimensions: int = 64) -> str:
    """vec (id, v) of the texts of src (id, text): the hashed embedding, in 128-bit integers modulo 2^64."""
    digit = lambda at: f"(instr('{HEXES}', substr(hex(encode(token)), CAST(2 * i + {at} AS BIGINT), 1)) - 1)"
    fold = lambda seed: f"list_reduce(list_prepend({seed}::HUGEINT, b), lambda h, x: (xor(h, x) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"
    edge = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
    return f"""
tok AS (SELECT id, regexp_replace(t, '{edge}', '', 'g') AS token FROM (SELECT id, unnest(regexp_split_to_array({low("text")}, '\\s+')) AS t FROM {src})),
bytes AS (SELECT token, list_transform(range(0, octet_length(encode(token))), lambda i: CAST({digit(1)} * 16 + {digit(2)} AS HUGEINT)) AS b FROM (SELECT DISTINCT token FROM tok WHERE token <> '')),
hashed AS MATERIALIZED (SELECT token, {fold(1469598103934665603)} AS h0, {fold(1099511628211)} AS h1, {fold(7809847782465536322)} AS h2 FROM bytes),
part AS (SELECT token, h0 % {dimensions} AS k, CASE WHEN h2 % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS v FROM hashed UNION ALL SELECT token, h1 % {dimensions}, CASE WHEN h2 % 2 = 0 THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END FROM hashed),
sums AS (SELECT id, CAST(k AS BIGINT) AS k, sum(v) AS v FROM tok JOIN part USING (token) GROUP BY ALL),
norms AS (SELECT id, sqrt(sum(v * v)) AS n FROM sums GROUP BY id),
vec AS (SELECT s.id, list(CASE WHEN n > 0 THEN coalesce(v, 0) / n ELSE 0.0 END ORDER BY r.k) AS v FROM (SELECT DISTINCT id FROM {src}) s CROSS JOIN (SELECT unnest(range(0, {dimensions})) AS k) r LEFT JOIN sums u ON u.id = s.id AND u.k = r.k LEFT JOIN norms m ON m.id = s.id GROUP BY s.id)"""


SIGNED = f"signed AS (SELECT *, {low('trim(content)')} AS sig, count(*) OVER s AS members, row_number() OVER (PARTITION BY namespace, {low('trim(content)')} ORDER BY updated_at DESC, importance DESC, id) AS place FROM docs WHERE {ALIVE} WINDOW s AS (PARTITION BY namespace, {low('trim(content)')}))"

def past(at: int) -> str:
    """Documents as they were: gone two hours after their time if 11 divides the number, in a second version one hour after it if 7 does."""
    n = "CAST(substr(id, 5) AS BIGINT)"
    second = f"{n} % 7 = 0 AND updated_at + {HOUR} <= {at}"
    return f"""
past AS (
  SELECT * REPLACE (CASE WHEN {second} THEN 'v2 ' || {n} ELSE content END AS content, CASE WHEN {second} THEN 'Active' ELSE quality_state END AS quality_state), CAST(NULL AS VARCHAR) AS summary, CAST(NULL AS BIGINT) AS expires_at
  FROM docs WHERE updated_at <= {at} AND NOT ({n} % 11 = 0 AND updated_at + 2 * {HOUR} <= {at})
)"""


COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"

ORACLE: dict[str, str] = {
    "recall_relevance": f"WITH {CHAT}, {scored(TERMS)} {TOP.format(order='round(CAST(total AS DOUBLE), 6) DESC, id')}",
    "recall_lexical_first": f"WITH {CHAT}, {scored(TERMS, (1.25, 0.35))} {TOP.format(order='round(CAST(total AS DOUBLE), 6) DESC, id')}",
    "recall_importance_first": f"WITH {CHAT}, {scored(TERMS, (0.75, 1.5))} {TOP.format(order='round(CAST(total AS DOUBLE), 6) DESC, id')}",
    "recall_curated": f"WITH {CHAT}, {scored(TERMS, (1.0, 1.0), curated=True)} {TOP.format(order='round(CAST(total AS DOUBLE), 6) DESC, id')}",
    "recall_empty_recent": f"WITH {CHAT}, {BLANK} {TOP.format(order='last_active DESC, importance DESC, id')}",
    "recall_chrono_asc": f"WITH {CHAT}, {scored(TERMS)} {TOP.format(order='last_active, total DESC, id')}",
    "recall_chrono_desc": f"WITH {CHAT}, {scored(TERMS)} {TOP.format(order='last_active DESC, total DESC, id')}",
    "score_breakdown": f"WITH {CHAT}, {scored(TERMS)} SELECT id, {r6('lexical', 'temporal', 'metadata', 'episodic', 'salience', 'policy', 'total')} FROM scored",
    "score_curated_breakdown": f"WITH {CHAT}, {scored(TERMS, (1.0, 1.0), curated=True)} SELECT id, {r6('lexical', 'temporal', 'metadata', 'episodic', 'salience', 'curation', 'policy', 'total')} FROM scored",
    "score_temporal_context": f"""WITH {CHAT}, {scored(["the", "timeline", "recurring", "handoff"], bonus="CASE WHEN prev IS NOT NULL OR next IS NOT NULL OR len(causal) > 0 THEN 0.2 ELSE 0 END + CASE WHEN rec_key IS NOT NULL THEN 0.2 + 0.1 + 7 / 30.0 * 0.1 ELSE 0 END + CASE WHEN boundary IS NOT NULL THEN 0.18 ELSE 0 END + 0.08", where="namespace = 'chat'")} SELECT id, {r6('temporal', 'total')} FROM scored WHERE actor_id = 'u3'""",
    "score_salience": f"WITH {CHAT} SELECT id, round(CAST({SALIENCE} AS DOUBLE), 6) AS salience FROM chat",
    "score_provenance_5_profiles": f"WITH {CHAT} " + " UNION ALL ".join(f"SELECT id, '{p}' AS profile, round(CAST({delta(p)} AS DOUBLE), 6) AS delta FROM chat" for p in PROFILES),
    "recall_batched_benchmark": f"""WITH {DOCS}, q AS (SELECT item_id, unnest(list_filter(regexp_split_to_array({low('text')}, '\\s+'), lambda x: x <> '')) AS term FROM benchmark),
        h AS MATERIALIZED (SELECT id, {low('content')} || ' ' AS hay, importance FROM docs WHERE namespace = 'en'), w AS MATERIALIZED (SELECT DISTINCT term FROM q),
        s AS (SELECT item_id AS query_id, id, count(*) AS lexical, any_value(importance) AS importance FROM (SELECT id, importance, term FROM h JOIN w ON contains(hay, term)) JOIN q USING (term) GROUP BY item_id, id)
        SELECT CAST(query_id AS VARCHAR) AS query_id, id, round(CAST(lexical + importance AS DOUBLE), 6) AS total, CAST(row_number() OVER (PARTITION BY query_id ORDER BY lexical + importance DESC, id) AS INTEGER) AS rank FROM s QUALIFY rank <= 5""",
    "recall_token_budget": f"""WITH RECURSIVE {CHAT}, {scored(TERMS)}, r AS (SELECT id, row_number() OVER (ORDER BY round(CAST(total AS DOUBLE), 6) DESC, id) AS k, len(list_filter(regexp_split_to_array(content, '\\s+'), lambda x: x <> '')) AS n FROM scored),
        walk AS (SELECT 0 AS k, CAST('' AS VARCHAR) AS id, CAST(400 AS BIGINT) AS rest, CAST(0 AS BIGINT) AS taken, false AS took
          UNION ALL SELECT r.k, r.id, CASE WHEN w.taken < 8 AND (w.taken = 0 OR r.n <= w.rest) THEN greatest(w.rest - r.n, 0) ELSE w.rest END, CASE WHEN w.taken < 8 AND (w.taken = 0 OR r.n <= w.rest) THEN w.taken + 1 ELSE w.taken END, w.taken < 8 AND (w.taken = 0 OR r.n <= w.rest) FROM walk w JOIN r ON r.k = w.k + 1)
        SELECT id, CAST(taken AS INTEGER) AS rank FROM walk WHERE took""",
    "recall_trace": f"""WITH {CHAT}, {scored(TERMS)}, r AS (SELECT *, row_number() OVER (ORDER BY round(CAST(total AS DOUBLE), 6) DESC, id) AS k FROM scored)
        SELECT id AS record_id, k <= 5 AS selected, CASE WHEN k <= 5 THEN CAST(k AS INTEGER) END AS selection_rank, CASE WHEN k <= 5 THEN 'retained' ELSE 'max_items_exhausted' END AS filter_reasons, CASE WHEN k <= 5 THEN 'selected_by_rank' ELSE 'excluded_by_rank' END AS decision_reason,
          array_to_string(list_filter([{', '.join(f"CASE WHEN contains({low('content')}, '{t}') THEN '{t}' END" for t in TERMS)}], lambda x: x IS NOT NULL), ',') AS matched_terms,
          array_to_string(list_filter([CASE WHEN conf_state IS NOT NULL THEN 'conflict' END, CASE WHEN episodic > 0 THEN 'episodic' END, 'lexical', CASE WHEN metadata > 0 THEN 'metadata' END, 'policy', 'salience'], lambda x: x IS NOT NULL), ',') AS selected_channels FROM r""",
    "filter_scope": ids("conversation_id = 'c3'"),
    "filter_time_range": ids(f"updated_at >= {BASE + 10 * HOUR} AND updated_at <= {BASE + 50 * HOUR} AND importance >= 0.4"),
    "filter_labels_all": ids("list_contains(labels, 'chat') AND list_contains(labels, 'user')"),
    "filter_trust_kind": ids("trust_level IN ('Verified', 'Observed') AND kind IN ('Episodic', 'Fact') AND source = 'user'"),
    "filter_unresolved": ids("ep_state IN ('Open', 'Abandoned')"),
    "filter_lineage": ids("(id = 'conv-23-0' OR list_contains(lineage_ids, 'conv-23-0'))"),
    "filter_relative_anchor": ids(f"last_active > {BASE + 3 * HOUR} AND last_active < {BASE + 13 * HOUR}"),
    "filter_boundary_recurrence": f"WITH {CHAT} SELECT id FROM chat WHERE actor_id = 'u5' AND boundary IN ('handoff') AND rec_key = 'weekly' AND {SEEN}",
    "filter_conflict": f"WITH {CHAT} SELECT id FROM chat WHERE conf_state IN ('PotentialConflict', 'UnderReview', 'Resolved') AND {SEEN}",
    "filter_conflict_resolution": f"WITH {CHAT} SELECT id FROM chat WHERE conf_res IN ('Accepted') AND {SEEN}",
    "filter_unresolved_conflicts": f"WITH {CHAT} SELECT id FROM chat WHERE conf_state IN ('PotentialConflict', 'UnderReview') AND {SEEN}",
    "filter_historical_modes": f"WITH {CHAT} SELECT id, 'HistoricalOnly' AS mode FROM chat WHERE historical <> 'Current' AND quality_state <> 'Archived' AND (expires_at IS NULL OR expires_at > {NOW}) UNION ALL SELECT id, 'IncludeHistorical' FROM chat WHERE quality_state <> 'Archived' AND (expires_at IS NULL OR expires_at > {NOW})",
    "filter_quality_visibility": f"WITH {CHAT} SELECT id, 'archived' AS mode FROM chat WHERE historical = 'Current' AND (expires_at IS NULL OR expires_at > {NOW}) UNION ALL SELECT id, 'drafts' FROM chat WHERE historical = 'Current' AND quality_state = 'Draft' AND (expires_at IS NULL OR expires_at > {NOW})",
    "filter_episode": ids("ep_id = 'c23' AND ep_state IN ('Open', 'Abandoned')"),
    "graph_edges": f"WITH {CHAT}, shown AS (SELECT * FROM chat WHERE quality_state <> 'Archived'), {EDGES} SELECT src, dst, kind, details FROM edges WHERE src <> dst AND (kind = 'EpisodeMembership' OR dst IN (SELECT id FROM shown))",
    "graph_nodes_capped": f"WITH {CHAT} SELECT id, kind, CAST(round(importance * 1000) AS INTEGER) AS importance_per_mille FROM chat WHERE quality_state <> 'Archived' ORDER BY id LIMIT 50",
    "expand_one_hop": f"WITH {CHAT}, {hops(1)}",
    "expand_two_hops": f"WITH {CHAT}, {hops(2)}",
    "namespace_stats": f"WITH {DOCS}, {CHAT}, u AS (SELECT tenant_id, namespace, quality_state, trust_level FROM docs UNION ALL SELECT tenant_id, namespace, quality_state, trust_level FROM chat) SELECT tenant_id, namespace, count(*) FILTER (WHERE {ALIVE}) AS active_records, count(*) FILTER (WHERE quality_state = 'Archived') AS archived_records, count(*) FILTER (WHERE quality_state = 'Deleted') AS deleted_records, count(*) FILTER (WHERE quality_state = 'Suppressed') AS suppressed_records, count(*) FILTER (WHERE trust_level = 'Pinned') AS pinned_records FROM u GROUP BY ALL",
    "maintenance_stats": f"WITH {CHAT}, g AS (SELECT count(*) AS m FROM chat WHERE {ALIVE} GROUP BY actor_id, {low('trim(content)')} HAVING count(*) > 1) SELECT count(*) FILTER (WHERE quality_state = 'Deleted') AS tombstoned_records, count(*) FILTER (WHERE expires_at <= {NOW}) AS expired_records, count(*) FILTER (WHERE historical = 'Historical') AS historical_records, count(*) FILTER (WHERE historical = 'Superseded') AS superseded_records, CAST(sum(len(lineage_ids)) AS BIGINT) AS lineage_links, (SELECT count(*) FROM g) AS duplicate_groups, CAST(coalesce((SELECT sum(m - 1) FROM g), 0) AS BIGINT) AS duplicate_records FROM chat",
    "duplicate_groups": f"WITH {DOCS} SELECT namespace, count(*) AS members, min(id) AS first_id FROM docs WHERE {ALIVE} GROUP BY namespace, {low('trim(content)')} HAVING count(*) > 1",
    "integrity_summary": f"WITH {CHAT}, g AS (SELECT count(*) AS m FROM chat WHERE {ALIVE} GROUP BY actor_id, {low('trim(content)')} HAVING count(*) > 1), t AS (SELECT conv_id, turn FROM conversations) SELECT (SELECT count(*) FROM t) AS scanned_records, (SELECT count(*) FROM t WHERE turn % 3 = 0) AS stale_idempotency_keys, (SELECT count(*) FROM t WHERE turn % 3 = 0) AS missing_idempotency_keys, (SELECT count(*) FROM g) AS duplicate_groups, CAST(coalesce((SELECT sum(m - 1) FROM g), 0) AS BIGINT) AS duplicate_records, (SELECT count(*) FROM t WHERE turn % 3 = 0) = 0 AND (SELECT count(*) FROM g) = 0 AS healthy",
    "compaction_plan": f"WITH {DOCS}, {SIGNED} SELECT id, first_value(id) OVER (PARTITION BY namespace, sig ORDER BY place) AS first_id, members, place > 1 AS superseded FROM signed WHERE members > 1",
    "compaction_rollups": f"""WITH {DOCS}, {SIGNED} SELECT 'compacted-summary-' || substr(md5(concat_ws(chr(31), 'acme', namespace, 'shared', 'Fact', sig, '')), 1, 16) AS id, any_value(members) AS members, round(max(importance), 6) AS importance_score, string_agg(id, ',' ORDER BY place) AS lineage,
        'Compacted ' || any_value(members) || ' related records into a durable summary. Representative memory: ' || arg_min(content, place) AS content,
          any_value(members) || ' related records: ' || arg_min(content, place) AS summary, array_to_string(arg_min(labels, place), ',') || ',compacted' AS labels, 'Summary' AS kind, 'Active' AS quality_state, arg_min(id, place) AS representative, CAST(any_value(members) AS VARCHAR) AS cluster_size FROM signed WHERE members >= 3 GROUP BY namespace, sig""",
    "cold_tier_candidates": f"WITH {CHAT} SELECT id FROM chat WHERE {ALIVE} AND {NOW} - updated_at > 86400000 AND importance <= 0.25",
    "retention_plan": f"WITH {CHAT} SELECT id, CASE WHEN coalesce(expires_at <= {NOW}, false) OR greatest({NOW} - created_at, 0) > 2 * 86400000 THEN 'delete' ELSE 'archive' END AS action FROM chat WHERE coalesce(expires_at <= {NOW}, false) OR greatest({NOW} - created_at, 0) > 2 * 86400000 OR ({ALIVE} AND greatest({NOW} - created_at, 0) > 86400000)",
    "retention_cap": f"WITH {CHAT}, {DOCS}, u AS (SELECT id, namespace, updated_at, importance FROM chat WHERE {ALIVE} AND NOT coalesce(expires_at <= {NOW}, false) UNION ALL SELECT id, namespace, updated_at, importance FROM docs WHERE {ALIVE}) SELECT id, 'archive_over_cap' AS action FROM (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY updated_at DESC, importance DESC, id DESC) AS r FROM u) WHERE r > 100",
    "synthesis_proposals": f"""WITH {CHAT}, g AS (SELECT *, row_number() OVER (PARTITION BY actor_id, conversation_id, session_id, source ORDER BY updated_at DESC, importance DESC, id) AS place, count(*) OVER (PARTITION BY actor_id, conversation_id, session_id, source) AS members FROM chat WHERE {ALIVE}),
        s AS (SELECT *, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS t FROM g WHERE members >= 2 AND place <= 3)
        SELECT 'synthesis-proposal-' || substr(md5(string_agg(id, chr(31) ORDER BY place)), 1, 16) AS id, string_agg(id, ',' ORDER BY place) AS source_record_ids, round(least(0.95, 0.55 + least(count(*), 9) * 0.05), 6) AS confidence, round(max(importance), 6) AS importance_score,
          'Synthesized ' || count(*) || ' source memories into a reviewable summary: ' || string_agg(CASE WHEN length(t) > 160 THEN left(t, 160) || '...' ELSE t END, '; ' ORDER BY place) AS content,
          array_to_string(any_value(labels), ',') || ',synthesized,review-required' AS labels, 'Draft' AS quality_state, 'Derived' AS trust_level, CAST(count(*) AS VARCHAR) AS source_count
        FROM s GROUP BY actor_id, conversation_id, session_id, source ORDER BY max(importance) DESC, id LIMIT 200""",
    "synthesis_counts": f"WITH {CHAT}, g AS (SELECT count(*) AS n FROM chat WHERE {ALIVE} GROUP BY actor_id, conversation_id, session_id, source) SELECT (SELECT count(*) FROM chat) AS scanned, (SELECT count(*) FROM chat WHERE {ALIVE}) AS eligible, count(*) FILTER (WHERE n >= 2) AS proposed, CAST(coalesce(sum(least(n, 3)) FILTER (WHERE n >= 2), 0) AS BIGINT) AS lineage_links FROM g",
    "export_manifest": f"WITH {DOCS} SELECT string_agg(DISTINCT tenant_id || ':' || namespace, ',' ORDER BY tenant_id || ':' || namespace) AS namespaces, count(*) AS record_count, CAST(sum(strlen(content)) AS BIGINT) AS content_bytes FROM docs WHERE quality_state <> 'Archived'",
    "snapshot_manifest": f"WITH {DOCS}, {CHAT}, u AS (SELECT namespace FROM docs UNION ALL SELECT namespace FROM chat) SELECT string_agg(DISTINCT namespace, ',' ORDER BY namespace) AS namespaces, count(*) AS record_count, CAST(12 AS BIGINT) AS storage_bytes FROM u",
    "import_merge_plan": f"WITH {DOCS} SELECT id FROM docs WHERE CAST(substr(id, 5) AS BIGINT) % 3 <> 0",
    "changefeed_page": "SELECT event_id + 1 AS sequence, 'evt-' || event_id AS record_id FROM events WHERE event_id + 1 > 50 ORDER BY 1 LIMIT 100",
    "as_of_snapshot": f"WITH {DOCS}, {past(BASE + 5 * HOUR)} SELECT id, content, quality_state FROM past",
    "version_tombstones": "SELECT 'doc-' || doc_id AS record_id FROM documents WHERE doc_id % 11 = 0",
    "as_of_recall": f"WITH {DOCS}, {past(BASE + 5 * HOUR)}, {scored(['the', 'v2', 'of'], frm='past', where=chr(34) + 'namespace' + chr(34) + ' = ' + chr(39) + 'en' + chr(39) + ' AND actor_id = ' + chr(39) + 'src1' + chr(39), source='src1', episodes=False)} SELECT id, CAST(row_number() OVER (ORDER BY round(CAST(total AS DOUBLE), 6) DESC, id) AS INTEGER) AS rank, {r6('lexical', 'total')} FROM scored QUALIFY rank <= 20",
    "cosine_topk": f"SELECT * FROM (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, round({COS}, 6) AS similarity, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY round({COS}, 6) DESC, b.vec_id) AS INTEGER) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id) WHERE rank <= 10",
    "ir_metrics": f"""WITH r AS (SELECT a.vec_id AS case_id, a.label AS l, b.vec_id, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({COS}, 6) DESC, b.vec_id) AS k FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        n AS (SELECT case_id, count(*) FILTER (WHERE l = label) AS n, count(*) FILTER (WHERE l = label AND k <= 10) AS found, min(k) FILTER (WHERE l = label) AS first, coalesce(sum(1 / log2(k + 1)) FILTER (WHERE l = label AND k <= 10), 0) AS dcg FROM r GROUP BY case_id)
        SELECT round(avg((found > 0)::INT), 6) AS hit_at_k, round(avg(CASE WHEN n > 0 THEN found / n ELSE 0 END), 6) AS recall_at_k, round(avg(coalesce(1 / first, 0)), 6) AS mrr, round(avg(CASE WHEN n > 0 THEN dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= n) ELSE 0 END), 6) AS ndcg_at_k, count(*) AS cases FROM n""",
    "latency_summary": "SELECT event_type, count(value) AS samples, round(avg(value), 6) AS mean, list_sort(list(value))[1 + CAST(round((count(value) - 1) * 0.5) AS BIGINT)] AS p50, list_sort(list(value))[1 + CAST(round((count(value) - 1) * 0.95) AS BIGINT)] AS p95, max(value) AS max, round(count(value) / 3600.0, 6) AS throughput_per_sec FROM events GROUP BY event_type",
    "case_assertions": """WITH c AS (SELECT CAST(conv_id AS VARCHAR) AS case_id, bool_or(role = 'user') AS u, bool_or(role = 'system') AS s, bool_or(role = 'assistant') AS a FROM conversations GROUP BY conv_id)
        SELECT case_id, u AND NOT s AND a AS passed, CASE WHEN u THEN '' ELSE 'user' END AS missing_expected, CASE WHEN s THEN 'system' ELSE '' END AS found_disallowed, CASE WHEN a THEN '' ELSE 'scorer=' END AS missing_notes, 'assistant,user' AS relevant FROM c""",
    "event_chains": f"WITH {EVENTS} SELECT id, ep_state, prev, next, round(importance, 6) AS importance_score FROM evts",
    "events_unresolved": f"WITH {EVENTS} SELECT id FROM evts WHERE ep_state IN ('Open', 'Abandoned') AND importance >= 0.1",
    "text_functions": f"SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '')) AS approximate_tokens, strlen(coalesce(text, '')) AS bytes, CASE WHEN length(t) > 160 THEN left(t, 160) || '...' ELSE t END AS snippet, {low('t')} AS lowered FROM (SELECT *, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t FROM documents)",
    "validation_failures": f"""WITH {DOCS}, b AS (SELECT unnest([CASE WHEN CAST(substr(id, 5) AS BIGINT) % 5 = 4 OR trim(namespace, E' \\t\\n\\r\\x0b\\x0c') = '' THEN 'namespace' END, CASE WHEN CAST(substr(id, 5) AS BIGINT) % 5 = 1 OR trim(actor_id, E' \\t\\n\\r\\x0b\\x0c') = '' THEN 'actor_id' END,
          CASE WHEN trim(content, E' \\t\\n\\r\\x0b\\x0c') = '' THEN 'content' END, CASE WHEN CAST(substr(id, 5) AS BIGINT) % 5 = 2 OR importance IS NULL OR importance NOT BETWEEN 0 AND 1 THEN 'importance_score' END]) AS rule FROM docs)
        SELECT rule, count(*) AS n FROM b WHERE rule IS NOT NULL GROUP BY rule""",
    "lifecycle_archive": f"WITH {CHAT} SELECT id, 'Archived' AS quality_state, CASE WHEN historical = 'Current' THEN 'Historical' ELSE historical END AS historical_state, (quality_state <> 'Archived' OR historical = 'Current') AS changed FROM chat",
    "tumbling_counts": "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "sliding_counts": "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts) - to_hours(k), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY ALL",
    "sessionized_events": "WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n FROM s GROUP BY user_id, k",
    "stream_dedup": "SELECT count(DISTINCT (user_id, event_type)) AS n FROM events",
    "compaction_counts": f"""WITH {DOCS}, {SIGNED}, c AS (SELECT count(*) AS n FROM signed WHERE trust_level <> 'Pinned' AND {NOW} - updated_at > 86400000 AND importance <= 0.25 AND NOT (members > 1 AND place > 1))
        SELECT count(*) FILTER (WHERE place > 1) AS deduplicated_records, count(*) FILTER (WHERE place > 1) + (SELECT n FROM c) AS archived_records, count(*) FILTER (WHERE place > 1) AS superseded_records,
          count(*) FILTER (WHERE place = 1 AND members >= 3) AS summarized_clusters, count(*) FILTER (WHERE members >= 3) + count(*) FILTER (WHERE place > 1) AS lineage_links_created FROM signed""",
    "changefeed_truncated": "SELECT count(*) > 100 AS truncated FROM events WHERE event_id + 1 > 50",
    "recall_explanation": f"""WITH {CHAT}, {scored(TERMS)} SELECT count(*) AS total_candidates_examined, array_to_string(list_filter(['lexical', 'policy', CASE WHEN bool_or(metadata > 0) THEN 'metadata' END, CASE WHEN bool_or(episodic > 0) THEN 'episodic' END, CASE WHEN bool_or(salience > 0) THEN 'salience' END,
          CASE WHEN bool_or(conf_state IS NOT NULL) THEN 'conflict' END], lambda x: x IS NOT NULL), ',') AS selected_channels, 'initial_spark_backend_scoring,scorer=Profile,scoring_profile=Balanced,planning_profile=FastPath,policy_profile=General,token_budget_applied' AS policy_notes FROM scored""",
    "recall_semantic": f"""WITH {CHAT}, said AS (SELECT id, content || ' ' AS text FROM chat WHERE actor_id = 'u3' UNION ALL SELECT '?', 'the answer user que'), {embedded('said')},
        like_ AS (SELECT a.id, greatest(0.0, list_inner_product(a.v, q.v)) AS likeness FROM vec a, (SELECT v FROM vec WHERE id = '?') q), known AS (SELECT c.*, likeness FROM chat c JOIN like_ USING (id)), {scored(TERMS, frm='known', semantic='likeness')}
        SELECT id, {r6('semantic', 'total')} FROM scored""",
    "recall_continuity_expansion": f"""WITH {CHAT}, {CONTINUITY}
        SELECT id, CAST(row_number() OVER (ORDER BY round(CAST(total AS DOUBLE), 9) DESC, id) AS INTEGER) AS rank, planner_stage, candidate_sources, relation_reasons, {r6('graph', 'total')} FROM every QUALIFY rank <= 20""",
    "planner_metrics": f"WITH {CHAT}, {CONTINUITY} SELECT (SELECT count(*) FROM scored) AS seeded_candidates, (SELECT count(*) FROM later) AS expanded_candidates, CASE WHEN (SELECT count(*) FROM hop2) > 0 THEN 2 WHEN (SELECT count(*) FROM hop1) > 0 THEN 1 ELSE 0 END AS hops_applied",
    "hash_embedding": f"WITH src AS (SELECT item_id AS id, text FROM benchmark), {embedded('src')} SELECT id AS item_id, k, round(v[k + 1], 6) AS v FROM (SELECT id, v, unnest(range(0, 64)) AS k FROM vec)",
    "hash_embedding_likeness": f"WITH src AS (SELECT item_id AS id, text FROM benchmark), {embedded('src', 16)} SELECT a.id AS item_id, round(list_inner_product(a.v, b.v), 6) AS likeness FROM vec a JOIN vec b ON a.id = b.id + 1",
    "recall_many_filters": f"""WITH {CHAT}, {scored(['the', 'user'], (1.25, 0.35), where="actor_id = 'u3' AND ep_state IN ('Open', 'Abandoned') AND importance >= 0.2", name='first_').strip()}, {scored(['la', 'der'], (1.25, 0.35), where="actor_id = 'u5'", source='assistant', name='second_').strip()}
        SELECT * FROM (SELECT 'unresolved' AS query_id, id, CAST(row_number() OVER (ORDER BY round(CAST(total AS DOUBLE), 9) DESC, id) AS INTEGER) AS rank, round(CAST(total AS DOUBLE), 6) AS total FROM first_ QUALIFY rank <= 5)
        UNION ALL SELECT * FROM (SELECT 'other', id, CAST(row_number() OVER (ORDER BY last_active DESC, total DESC, id) AS INTEGER) AS rank, round(CAST(total AS DOUBLE), 6) FROM second_ QUALIFY rank <= 4)""",
    "score_duration_context": f"""WITH {CHAT}, {scored("how long after the session what happened next what changed".split(), bonus="CASE WHEN prev IS NOT NULL OR next IS NOT NULL OR len(causal) > 0 THEN 0.2 ELSE 0 END + 0.15 + least((last_active - started) / 3600000.0, 24) / 24 * 0.2 + CASE WHEN boundary IS NOT NULL THEN 0.18 ELSE 0 END + 0.08", more="CASE WHEN prev IS NOT NULL THEN 0.25 ELSE 0 END + CASE WHEN next IS NOT NULL THEN 0.25 ELSE 0 END")}
        SELECT id, {r6('temporal', 'episodic', 'total')} FROM scored""",
    "score_provenance_asked": f"WITH {CHAT} " + " UNION ALL ".join(f"SELECT id, '{p}' AS profile, round(CAST({delta(p, asked=True)} AS DOUBLE), 6) AS delta FROM chat" for p in PROFILES),
    "graph_edges_scoped": f"WITH {CHAT}, shown AS (SELECT * FROM chat WHERE actor_id = 'u3' AND session_id = 's1'), {EDGES} SELECT src, dst, kind, details FROM edges WHERE src <> dst AND (kind = 'EpisodeMembership' OR dst IN (SELECT id FROM shown))",
    "graph_truncated": f"WITH {CHAT} SELECT (SELECT count(*) FROM chat) AS total_records_scanned, least(count(*), 50) AS nodes, count(*) > 50 AS truncated FROM chat WHERE conversation_id = 'c3' AND quality_state NOT IN ('Suppressed', 'Deleted')",
    "judged_benchmark": f"""WITH {DOCS}, q AS (SELECT item_id, unnest(list_filter(regexp_split_to_array({low('text')}, '\\s+'), lambda x: x <> '')) AS term FROM benchmark),
        h AS MATERIALIZED (SELECT id, {low('content')} || ' ' AS hay, importance FROM docs WHERE namespace = 'en'), w AS MATERIALIZED (SELECT DISTINCT term FROM q),
        s AS (SELECT item_id, id, count(*) + any_value(importance) AS total FROM (SELECT id, importance, term FROM h JOIN w ON contains(hay, term)) JOIN q USING (term) GROUP BY item_id, id),
        r AS (SELECT item_id, id, row_number() OVER (PARTITION BY item_id ORDER BY total DESC, id) AS k FROM s QUALIFY k <= 10), j AS MATERIALIZED (SELECT item_id, id FROM docs JOIN benchmark b ON contains(content, b.text)),
        n AS (SELECT item_id, count(*) AS n FROM j GROUP BY item_id), f AS (SELECT item_id, count(*) FILTER (WHERE k <= 3) AS found, min(k) AS first, coalesce(sum(1 / log2(k + 1)) FILTER (WHERE k <= 3), 0) AS dcg FROM r JOIN j USING (item_id, id) GROUP BY item_id)
        SELECT round(avg((coalesce(found, 0) > 0)::INT), 6) AS hit_at_k, round(avg(coalesce(found / n, 0)), 6) AS recall_at_k, round(avg(coalesce(1 / first, 0)), 6) AS mrr,
          round(avg(CASE WHEN n > 0 THEN coalesce(dcg, 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 4) t(i) WHERE i <= n) ELSE 0 END), 6) AS ndcg_at_k, count(*) AS cases FROM benchmark LEFT JOIN n USING (item_id) LEFT JOIN f USING (item_id)""",
    "limit_violations": f"WITH {DOCS}, {CHAT}, u AS (SELECT labels, content FROM docs UNION ALL SELECT labels, content FROM chat) SELECT * FROM (SELECT 'labels' AS rule, count(*) AS n FROM u WHERE len(labels) > 1 UNION ALL SELECT 'content', count(*) FROM u WHERE strlen(content) > 8192) WHERE n > 0",
    "idempotency_parsed": """SELECT 'conv-' || conv_id || '-' || turn AS record_id, conv_id % 7 <> 0 AS well_formed, CASE WHEN conv_id % 7 = 0 THEN 'no parts' ELSE 'acme' END AS tenant_id, CASE WHEN conv_id % 7 <> 0 THEN 'chat' END AS namespace, CASE WHEN conv_id % 7 <> 0 THEN 'u' || (conv_id % 10) END AS actor_id,
          CASE WHEN conv_id % 7 <> 0 THEN 'c' || conv_id END AS conversation_id, CASE WHEN conv_id % 7 <> 0 THEN 's' || (conv_id % 3) END AS session_id, CASE WHEN conv_id % 7 <> 0 THEN 'k-conv-' || conv_id || '-' || turn || CASE WHEN turn % 3 = 0 THEN '-old' ELSE '' END END AS key FROM conversations WHERE conv_id % 5 <> 0""",
    "idempotency_repaired": "SELECT 'conv-' || conv_id || '-' || turn AS record_id, concat_ws('|', 'acme', 'chat', 'u' || (conv_id % 10), 'c' || conv_id, 's' || (conv_id % 3), 'k-conv-' || conv_id || '-' || turn) AS scoped_key FROM conversations",
    "retention_applied": f"WITH {CHAT}, r AS (SELECT *, {ALIVE} AND {NOW} - created_at > 3 * 86400000 AS old FROM chat WHERE NOT coalesce(expires_at <= {NOW}, false) AND NOT {NOW} - created_at > 4 * 86400000) SELECT id, CASE WHEN old THEN 'Archived' ELSE quality_state END AS quality_state, CASE WHEN old THEN 'Historical' ELSE historical END AS historical_state, CASE WHEN old THEN {NOW} ELSE updated_at END AS updated_at_unix_ms FROM r",
    "lifecycle_suppress": f"WITH {CHAT} SELECT id, 'Suppressed' AS quality_state, historical AS historical_state, {NOW} AS updated_at_unix_ms, true AS changed FROM chat",
    "lifecycle_recover": f"WITH {CHAT} SELECT id, 'Verified' AS quality_state, 'Historical' AS historical_state, {NOW} AS updated_at_unix_ms, true AS changed FROM chat",
    "tenant_load": "WITH t AS (SELECT 'u' || (user_id % 7) AS tenant_id, CASE WHEN event_id % 9 <> 0 THEN CAST(floor(value) AS BIGINT) END AS w, event_id % 4 = 0 AS under_way FROM events) SELECT tenant_id, count(*) FILTER (WHERE w IS NOT NULL AND under_way) AS inflight, count(*) FILTER (WHERE w IS NULL) AS queued, CAST(coalesce(floor(avg(w)), 0) AS BIGINT) AS average_queue_wait_ms, coalesce(max(w), 0) AS max_queue_wait_ms FROM t GROUP BY tenant_id",
    "traces_listed": f"SELECT 't' || event_id AS trace_id, epoch_us(ts) // 1000 AS started_at_unix_ms FROM events WHERE event_type = 'error' AND epoch_us(ts) // 1000 <= {BASE + 200 * HOUR} ORDER BY epoch_us(ts) // 1000 DESC, 't' || event_id LIMIT 50",
}
