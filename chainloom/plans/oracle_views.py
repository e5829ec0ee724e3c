"""The same chain-shaped views as DuckDB common table expressions, for the oracle SQL."""

from __future__ import annotations

from ..functions import vocab as V


def values(rows, *names: str) -> str:
    """A VALUES list; strings are quoted, None is NULL."""
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, (int, float)):
            return str(v)
        return "'" + v.replace("'", "''") + "'"
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS _v({', '.join(names)})"


def texts(items) -> str:
    return "[" + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + "]"


MAP_SEL = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in V.FACT_BY_SELECTOR.items()) + "}"

# name -> (needed views, body)
VIEWS: dict[str, tuple[list[str], str]] = {}


def view(name: str, needs: list[str], body: str) -> None:
    VIEWS[name] = (needs, body)


view("moves_raw", [], f"""
SELECT l_orderkey AS block_number, l_linenumber AS log_index, '0x' || sha256(CAST(l_orderkey AS VARCHAR)) AS tx_hash,
  CAST(l_suppkey % 3 AS INTEGER) AS contract_no,
  '0x' || lpad(CAST(o_custkey AS VARCHAR), 40, '0') AS from_addr,
  CASE WHEN l_partkey % 50 = 0 THEN '0x' || lpad(CAST(o_custkey AS VARCHAR), 40, '0')
       WHEN l_partkey % 50 = 1 THEN '{V.ZERO_ADDRESS}'
       ELSE '0x5' || lpad(CAST(l_suppkey AS VARCHAR), 39, '0') END AS to_addr,
  CASE WHEN l_linenumber = 7 THEN CAST(0 AS DECIMAL(38,0))
       WHEN l_linenumber = 6 THEN CAST(l_partkey AS DECIMAL(38,0))
       ELSE CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS DECIMAL(38,0)) * CAST(100000000000000 AS DECIMAL(15,0)) END AS value,
  o_orderdate AS block_time, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
view("moves", ["moves_raw"], """
SELECT * FROM moves_raw
QUALIFY row_number() OVER (PARTITION BY block_number, log_index ORDER BY l_partkey, l_suppkey, l_quantity,
  l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag) = 1""")
view("transfers", ["moves"], "SELECT * FROM moves WHERE log_index NOT IN (3, 4, 5)")
view("blocks", ["moves"], "SELECT block_number, min(block_time) AS block_time FROM moves GROUP BY 1")
_POOL = "'0x' || sha256('pool' || CAST(l_partkey AS VARCHAR))"
view("swaps", ["moves"], f"""
SELECT block_number, log_index, tx_hash, contract_no, {_POOL} AS pool, from_addr AS sender,
  value * (CASE l_returnflag WHEN 'A' THEN -1 WHEN 'N' THEN 1 ELSE 0 END)::DECIMAL(1,0) AS amount0,
  CAST(l_quantity AS BIGINT) * -1000000 * (CASE l_returnflag WHEN 'A' THEN -1 WHEN 'N' THEN 1 ELSE 0 END) AS amount1,
  500 + l_partkey % 50 * 100 AS fee
FROM moves WHERE log_index = 5""")
view("modifies", ["moves"], f"""
SELECT block_number, log_index, tx_hash, contract_no, {_POOL} AS pool, from_addr AS sender,
  value * (CASE l_returnflag WHEN 'A' THEN -1 ELSE 1 END)::DECIMAL(1,0) AS liquidity_delta,
  CAST(-l_quantity AS BIGINT) AS tick_lower, CAST(l_quantity AS BIGINT) AS tick_upper
FROM moves WHERE log_index = 4""")
view("donates", ["moves"], f"""
SELECT block_number, log_index, tx_hash, contract_no, {_POOL} AS pool, from_addr AS sender, value AS amount0,
  CAST(l_quantity AS BIGINT) * 1000000 AS amount1
FROM moves WHERE log_index = 3""")
view("inits", [], f"""
SELECT p_partkey AS block_number, 0 AS log_index, '0x' || sha256(CAST(p_partkey AS VARCHAR)) AS tx_hash,
  '0x' || sha256('pool' || CAST(p_partkey AS VARCHAR)) AS pool,
  CASE p_partkey % 3 WHEN 0 THEN '{V.ZERO_ADDRESS}' WHEN 1 THEN '{V.USDC}'
    ELSE '0x7' || lpad(CAST(p_partkey AS VARCHAR), 39, '0') END AS currency0,
  '0x8' || lpad(CAST(p_partkey AS VARCHAR), 39, '0') AS currency1,
  500 + p_partkey % 50 * 100 AS fee, CAST(p_size AS BIGINT) AS tick_spacing, '{V.ZERO_ADDRESS}' AS hooks
FROM part""")
_SUP = "'0x5' || lpad(CAST({} AS VARCHAR), 39, '0')"
view("ctx", [], f"""
SELECT '0x' || sha256(CAST(o_orderkey AS VARCHAR)) AS tx_hash, o_orderkey AS block_number,
  CASE o_orderpriority WHEN '1-URGENT' THEN '{V.UNIVERSAL_ROUTER}' WHEN '2-HIGH' THEN '0x28b5a0e9c621a5badaa536219b3a228c8168cf5d'
    WHEN '3-MEDIUM' THEN '{V.USDC}' WHEN '4-NOT SPECIFIED' THEN {_SUP.format('o_custkey')} ELSE '0x{"c9" * 20}' END AS ctx_to,
  CASE o_orderpriority WHEN '1-URGENT' THEN '0x3593564c' WHEN '2-HIGH' THEN '0x8e0250ee' WHEN '3-MEDIUM' THEN '0xa9059cbb'
    WHEN '4-NOT SPECIFIED' THEN '0x' ELSE '0xdeadbeef' END AS selector,
  CASE o_orderstatus WHEN 'F' THEN ['{V.TRANSFER_TOPIC}', '{V.SWAP_V3}', '{V.HOOK_FEE}']
    WHEN 'P' THEN ['{V.TRANSFER_TOPIC}', '{V.USER_OPERATION}'] ELSE ['{V.TRANSFER_TOPIC}'] END AS topics,
  '0x' || lpad(CAST(o_custkey AS VARCHAR), 40, '0') AS sender,
  CASE o_orderstatus WHEN 'F' THEN ['{V.USDC}', '0xb1' || lpad(CAST(o_orderkey AS VARCHAR), 38, '0'), '0x{"e1" * 20}']
    WHEN 'P' THEN ['{V.USDC}', '0x{"e1" * 20}'] ELSE ['{V.USDC}'] END AS emitters,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN '{V.AERODROME_FACTORY}' END AS factory,
  o_orderkey % 5 = 0 AS value_sent
FROM orders WHERE o_orderkey % 37 <> 0""")
view("facts", ["ctx"], f"""
SELECT tx_hash, list_filter({texts(V.FACT_ORDER)}, lambda f: list_contains(found, f)) AS facts FROM (
  SELECT c.tx_hash, list(x.fact) AS found FROM (
    SELECT tx_hash, selector AS mark FROM ctx UNION ALL SELECT tx_hash, unnest(topics) FROM ctx) c
  LEFT JOIN (SELECT * FROM {values([*V.FACT_BY_SELECTOR.items(), *V.FACT_BY_TOPIC.items()], 'mark', 'fact')}) x ON x.mark = c.mark
  GROUP BY 1)""")
_RULES = [(i, name, mark) for i, (name, sels, tops) in enumerate(V.PROTOCOL_RULES) for mark in [*sels, *tops]]
view("protocols", ["ctx"], f"""
SELECT c.tx_hash, coalesce(r.name, CASE
    WHEN list_contains({texts(V.VENUE_ENTRY_POINTS)}, ctx_to) OR list_contains(emitters, '{V.POOL_MANAGER}') THEN 'Uniswap'
    WHEN factory = '{V.UNISWAP_FACTORY}' THEN 'Uniswap' WHEN factory = '{V.AERODROME_FACTORY}' THEN 'Aerodrome' END, '') AS protocol
FROM ctx c LEFT JOIN (
  SELECT m.tx_hash, arg_min(x.name, x.pri) AS name FROM (
    SELECT tx_hash, selector AS mark FROM ctx UNION ALL SELECT tx_hash, unnest(topics) FROM ctx) m
  JOIN (SELECT * FROM {values(_RULES, 'pri', 'name', 'mark')}) x ON x.mark = m.mark GROUP BY 1) r ON r.tx_hash = c.tx_hash""")
view("kinds", ["ctx", "moves"], f"""
SELECT a.address, CASE WHEN s.address IS NOT NULL THEN false
    WHEN c.code IS NULL THEN NULL
    WHEN c.code IN ('', '0x', '0x0') THEN false
    ELSE NOT (lower(c.code) LIKE '0xef0100%' AND length(c.code) = 48) END AS is_contract
FROM (SELECT from_addr AS address FROM moves UNION SELECT to_addr FROM moves) a
LEFT JOIN (SELECT DISTINCT sender AS address FROM ctx) s ON s.address = a.address
LEFT JOIN (
  SELECT '0x5' || lpad(CAST(s_suppkey AS VARCHAR), 39, '0') AS address,
    CASE WHEN s_suppkey % 7 = 0 THEN '0xEF0100' || lpad(CAST(s_suppkey AS VARCHAR), 40, '0') ELSE '0x6080604052' END AS code FROM supplier
  UNION ALL SELECT '0x' || lpad(CAST(c_custkey AS VARCHAR), 40, '0'), '0x' FROM customer WHERE c_custkey % 10 <> 3) c ON c.address = a.address
WHERE a.address <> '{V.ZERO_ADDRESS}'""")
view("ev", [], """
SELECT event_id // 4 AS block_number, CAST(event_id % 4 AS INTEGER) AS log_index,
  '0x' || sha256('t' || CAST(event_id // 4 AS VARCHAR) || '-' || CAST(event_id % 4 % 2 AS VARCHAR)) AS tx_hash,
  '0x' || lpad(CAST(user_id AS VARCHAR), 40, '0') AS from_addr,
  '0x5' || lpad(CAST(user_id % 10 AS VARCHAR), 39, '0') AS to_addr,
  CAST(round(value * 100) AS BIGINT) AS value, ts AS t,
  CASE event_type WHEN 'click' THEN 'swap' WHEN 'view' THEN 'payment' WHEN 'purchase' THEN 'vault' WHEN 'signup' THEN 'bridge' END AS lane,
  event_id, event_type, user_id
FROM events""")


def _case(column: str, items) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {k} THEN {v}" for k, v in items) + " END"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _phrase(table, fact: str = "f") -> str:
    return _case(fact, [(_quoted(k), _quoted(v)) for k, v in table.items()])


def _bucket(value: str, label: str, decimals: str) -> str:
    v, p = f"CAST({value} AS HUGEINT)", f"CAST(pow(10, coalesce({decimals}, 0)) AS HUGEINT)"
    return (f"CASE WHEN {value} = 0 THEN 'zero ' || {label} WHEN {decimals} IS NULL THEN 'a nonzero amount of ' || {label} "
            f"WHEN {v} * 100 < {p} THEN 'less than one cent of ' || {label} WHEN {v} < {p} THEN 'under 1 ' || {label} "
            f"WHEN {v} < 100 * {p} THEN '1 to 100 ' || {label} WHEN {v} < 10000 * {p} THEN '100 to 10,000 ' || {label} "
            f"ELSE 'over 10,000 ' || {label} END")


def _kind(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 'an account' WHEN {c} THEN 'a contract' ELSE 'a wallet' END"


def _head_sql(label: str, amount: str) -> str:
    z = V.ZERO_ADDRESS
    return (f"CASE WHEN from_addr = '{z}' THEN {label} || ' was minted to ' || {_kind('to_kind')} || ', amount ' || {amount} || '.' "
            f"WHEN to_addr = '{z}' THEN {label} || ' was burned from ' || {_kind('from_kind')} || ', amount ' || {amount} || '.' "
            f"ELSE {label} || ' moved from ' || {_kind('from_kind')} || ' to ' || {_kind('to_kind')} || ', amount ' || {amount} || '.' END")


def _tail_sql(phrases, extra: str = "''") -> str:
    said = f"array_to_string(list_transform(facts, lambda f: {_phrase(phrases)} || CASE WHEN f = 'bridge' THEN {extra} ELSE '' END), '; ')"
    return (f"CASE WHEN NOT readable THEN 'The rest of the transaction could not be read.' ELSE 'In the same transaction: ' || "
            f"CASE WHEN len(facts) > 0 THEN {said} WHEN plain THEN 'it was a plain direct transfer' "
            f"ELSE 'nothing else recognisable happened' END || '.' END")


_C9 = "0x" + "c9" * 20
_MESSENGER = "0x28b5a0e9c621a5badaa536219b3a228c8168cf5d"
view("events_all", ["transfers", "swaps", "modifies", "donates"], f"""
SELECT block_number, log_index, tx_hash, true AS is_transfer, 'Transfer' AS event,
  CASE contract_no WHEN 0 THEN 'usdc' WHEN 1 THEN 'native' ELSE 'mystery' END AS contract_name,
  CASE contract_no WHEN 0 THEN '{V.USDC}' WHEN 1 THEN '{V.NATIVE_USDC}' ELSE '0x{"7" * 40}' END AS contract_address,
  from_addr, to_addr, value, CASE contract_no WHEN 2 THEN 'mystery' ELSE 'USDC' END AS label,
  CASE contract_no WHEN 2 THEN NULL ELSE 18 END AS decimals FROM transfers
UNION ALL SELECT block_number, log_index, tx_hash, false, 'Swap', 'pool_manager', '{V.POOL_MANAGER}', NULL, NULL, NULL, NULL, NULL FROM swaps
UNION ALL SELECT block_number, log_index, tx_hash, false, 'ModifyLiquidity', 'pool_manager', '{V.POOL_MANAGER}', NULL, NULL, NULL, NULL, NULL FROM modifies
UNION ALL SELECT block_number, log_index, tx_hash, false, 'Donate', 'pool_manager', '{V.POOL_MANAGER}', NULL, NULL, NULL, NULL, NULL FROM donates""")
_SAID = texts([*V.FACT_BY_SELECTOR, *V.PLAIN_SELECTORS])
view("described0", ["events_all", "ctx", "facts", "protocols", "kinds"], f"""
SELECT e.*, c.tx_hash IS NOT NULL AS readable, c.selector, c.topics, c.ctx_to, c.value_sent, coalesce(f.facts, CAST([] AS VARCHAR[])) AS facts,
  kf.is_contract AS from_kind, kt.is_contract AS to_kind,
  coalesce(len(f.facts) = 0 AND list_contains({texts(V.PLAIN_SELECTORS)}, c.selector) AND (c.ctx_to = e.contract_address OR c.selector = '0x'), false) AS plain,
  coalesce(nullif(p.protocol, ''), CASE c.ctx_to WHEN '{V.USDC}' THEN 'usdc' WHEN '{_C9}' THEN 'vaultish' WHEN '{_MESSENGER}' THEN 'messenger' END, '') AS protocol,
  CASE WHEN c.ctx_to = '{_C9}' AND c.selector = '0xdeadbeef' THEN 'It was called with poke.' ELSE '' END AS called_phrase
FROM events_all e LEFT JOIN ctx c ON c.tx_hash = e.tx_hash LEFT JOIN facts f ON f.tx_hash = e.tx_hash
LEFT JOIN protocols p ON p.tx_hash = e.tx_hash LEFT JOIN kinds kf ON kf.address = e.from_addr LEFT JOIN kinds kt ON kt.address = e.to_addr""")
view("described", ["described0"], f"""
SELECT *, (CASE WHEN is_transfer THEN {_head_sql('label', _bucket('value', 'label', 'decimals'))}
    ELSE 'The ' || contract_name || ' contract logged ' || event || '.' END)
  || CASE WHEN called_phrase <> '' THEN ' ' || called_phrase ELSE '' END || ' ' || {_tail_sql(V.FACT_PHRASE)} AS sentence,
  CASE WHEN NOT readable THEN 'uncertain'
    WHEN NOT is_transfer THEN CASE WHEN value_sent OR list_has_any(topics, {texts(V.MOVEMENT_TOPICS)}) THEN '' ELSE 'no_transfer' END
    WHEN (from_addr = '{V.ZERO_ADDRESS}' OR to_addr = '{V.ZERO_ADDRESS}') AND NOT list_contains(facts, 'bridge') THEN 'issuance'
    WHEN value = 0 AND len(list_filter(facts, lambda f: NOT list_contains({texts(V.INCIDENTAL_FACTS)}, f))) = 0 THEN 'spam'
    WHEN len(facts) = 0 AND NOT plain AND called_phrase = '' THEN 'uncertain' ELSE '' END AS ruled
FROM described0""")
_MARKS = "list_concat([selector], topics)"
view("live0", ["moves", "ctx", "facts", "protocols", "kinds"], f"""
SELECT m.block_number, m.log_index, m.tx_hash, m.from_addr, m.to_addr, m.block_time,
  CAST((CAST(m.value AS HUGEINT) + 999999999999) // 1000000000000 AS BIGINT) AS value,
  c.tx_hash IS NOT NULL AS readable, c.selector, c.topics, c.ctx_to, coalesce(f.facts, CAST([] AS VARCHAR[])) AS facts,
  kf.is_contract AS from_kind, kt.is_contract AS to_kind,
  coalesce(len(f.facts) = 0 AND list_contains({texts(V.PLAIN_SELECTORS)}, c.selector) AND (c.ctx_to = '{V.USDC}' OR c.selector = '0x'), false) AS plain,
  CASE WHEN c.tx_hash IS NULL THEN '' WHEN p.protocol <> '' THEN p.protocol WHEN c.ctx_to = '{V.USDC}' OR c.selector = '0x' THEN 'USDC' ELSE '' END AS protocol,
  CASE WHEN list_has_any({_MARKS}, {texts(V.BRIDGE_OUT)}) AND NOT list_has_any({_MARKS}, {texts(V.BRIDGE_IN)}) THEN 'out'
    WHEN list_has_any({_MARKS}, {texts(V.BRIDGE_IN)}) AND NOT list_has_any({_MARKS}, {texts(V.BRIDGE_OUT)}) THEN 'in' ELSE '' END AS direction
FROM moves m LEFT JOIN ctx c ON c.tx_hash = m.tx_hash LEFT JOIN facts f ON f.tx_hash = m.tx_hash
LEFT JOIN protocols p ON p.tx_hash = m.tx_hash LEFT JOIN kinds kf ON kf.address = m.from_addr LEFT JOIN kinds kt ON kt.address = m.to_addr""")
_LIVE_BUCKET = _bucket("value", "'USDC'", "6")
_SIZE = _case(_LIVE_BUCKET, [(_quoted(k), _quoted(f" ({v})")) for k, v in V.SIZE_WORDS.items()])
LIVE_WORDS = f"({_LIVE_BUCKET}) || coalesce({_SIZE}, '')"
_WAY = f"CASE direction WHEN 'out' THEN ' (out of {V.CHAIN})' WHEN 'in' THEN ' (into {V.CHAIN})' ELSE '' END"


def short_sql(a: str) -> str:
    return f"left({a}, 6) || '…' || right({a}, 4)"


view("live", ["live0"], f"""
SELECT *, {_head_sql("'USDC'", _LIVE_BUCKET)} || ' ' || {_tail_sql(V.FACT_PHRASE)} AS sentence,
  {_head_sql("'USDC'", LIVE_WORDS)} || ' ' || {_tail_sql(V.STORY_PHRASE, _WAY)}
    || CASE WHEN protocol IN ('', 'USDC') THEN '' ELSE ' Protocol: ' || protocol || '.' END AS story,
  format('{{:,.2f}}', CAST(value AS DOUBLE) / 1000000) || ' USDC · ' || {short_sql('from_addr')} || ' → ' || {short_sql('to_addr')} AS text,
  CASE WHEN NOT readable THEN 'uncertain'
    WHEN (from_addr = '{V.ZERO_ADDRESS}' OR to_addr = '{V.ZERO_ADDRESS}') AND NOT list_contains(facts, 'bridge') THEN 'issuance'
    WHEN value = 0 AND len(list_filter(facts, lambda f: NOT list_contains({texts(V.INCIDENTAL_FACTS)}, f))) = 0 THEN 'spam'
    WHEN len(facts) = 0 AND NOT plain THEN 'uncertain' ELSE '' END AS ruled
FROM live0""")


def _hash_sql(text: str) -> str:
    return f"CAST('0x' || substr(sha1({text}), 1, 8) AS BIGINT) % 10000"


_RAW = "[" + ", ".join(f"CAST({_hash_sql(f'''sentence || '{i}' ''')} AS DOUBLE)" for i in range(len(V.LANES))) + "]"


def _scored(name: str, base: str, p: str, ruled_p: str) -> None:
    """<name>: rows of ``base`` with probs, choice, lane and lane_p; an unruled sentence is scored once."""
    view(name + "_answers", [base], f"""
SELECT sentence, probs, {texts(V.LANES)}[list_position(probs, list_max(probs))] AS choice FROM (
  SELECT sentence, list_transform(raw, lambda x: x / list_sum(raw)) AS probs FROM (
    SELECT sentence, {_RAW} AS raw FROM (SELECT DISTINCT sentence FROM {base} WHERE ruled = '')))""")
    raw_p = "CASE WHEN a.choice = 'spam' THEN list_max(a.probs[1:7]) ELSE list_max(a.probs) END"
    view(name, [base, name + "_answers"], f"""
SELECT *, CASE WHEN ruled <> '' THEN ruled WHEN got_p < {V.UNCERTAIN_BELOW} THEN 'uncertain' ELSE got END AS lane,
  CASE WHEN ruled <> '' THEN {ruled_p} ELSE got_p END AS lane_p FROM (
  SELECT d.*, a.probs, a.choice, CASE WHEN a.choice = 'spam' THEN {texts(V.LANES)}[list_position(a.probs[1:7], list_max(a.probs[1:7]))] ELSE a.choice END AS got,
    {p.format(raw_p)} AS got_p
  FROM {base} d LEFT JOIN {name}_answers a ON d.ruled = '' AND a.sentence = d.sentence)""")


_scored("scored", "described", "round({}, 3)", "NULL")
_scored("live_scored", "live", "CAST(printf('%.3f', {}) AS DOUBLE)", "CASE ruled WHEN 'uncertain' THEN 0.0 ELSE 1.0 END")


def sql(needs: list[str], body: str) -> str:
    """``body`` behind the common table expressions it needs, each stated once and in order."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in order:
            return
        for n in VIEWS[name][0]:
            add(n)
        order.append(name)

    for n in needs:
        add(n)
    body = body.strip()
    extra = ""
    if body.upper().startswith("WITH "):
        extra, body = body[5:], ""
    ctes = ", ".join(f"{n} AS ({VIEWS[n][1].strip()})" for n in order)
    if extra:
        return f"WITH {ctes + ', ' if ctes else ''}{extra}"
    return f"WITH {ctes} {body}" if ctes else body
