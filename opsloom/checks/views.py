"""SQL twins of the domain views in ``opsloom.sources.tables``."""

TRANSACTIONS = """
v_txn AS (
 SELECT *, 'acct-'||CAST(account_no AS VARCHAR) AS account_id, 'u'||CAST(account_no%10 AS VARCHAR) AS user_id,
        'imp-'||CAST(account_no AS VARCHAR)||'-'||CAST(year(date) AS VARCHAR) AS import_id
 FROM (
  SELECT 'L'||CAST(l_orderkey AS VARCHAR)||'-'||CAST(l_partkey AS VARCHAR)||'-'||CAST(l_suppkey AS VARCHAR)||'-'||CAST(l_linenumber AS VARCHAR) AS id,
         CAST(l_shipdate AS DATE) AS date,
         CAST((CASE WHEN l_returnflag='R' THEN 1 ELSE -1 END)*CAST(round(l_extendedprice*100) AS BIGINT) AS BIGINT) AS amount_cents,
         'expense' AS direction, CASE WHEN l_quantity<>1 THEN p_type END AS category_id, p_brand AS merchant,
         upper(p_brand||' '||p_name) AS description,
         CASE WHEN l_linestatus='F' THEN 'reviewed' ELSE 'parsed' END AS status,
         CASE l_linenumber%4 WHEN 0 THEN 'user' WHEN 1 THEN 'rule' WHEN 2 THEN 'import' ELSE 'none' END AS category_source,
         l_orderkey%50 AS account_no, (l_discount=0.1::DOUBLE AND l_tax=0.08::DOUBLE) AS excluded, l_linenumber AS source_line
  FROM lineitem JOIN part ON l_partkey=p_partkey
  UNION ALL
  SELECT 'O'||CAST(o_orderkey AS VARCHAR), CAST(o_orderdate AS DATE), CAST(round(o_totalprice*100) AS BIGINT),
         CASE WHEN o_orderstatus='P' THEN 'transfer' ELSE 'income' END,
         CASE WHEN o_orderstatus='P' THEN 'Transfer' ELSE 'Income' END,
         'Payer '||o_orderpriority, upper('deposit '||o_orderpriority), 'parsed', 'rule', o_orderkey%50, false, 0
  FROM orders))
"""
LEDGER = TRANSACTIONS + ", v_ledger AS (SELECT * FROM v_txn WHERE NOT excluded)\n"
CATEGORIES = """
v_cat AS (
 SELECT DISTINCT p_type AS id, p_type AS name,
   CASE WHEN p_type IN ('LARGE','MEDIUM','SMALL') THEN 'Goods' WHEN p_type IN ('PROMO','ECONOMY') THEN 'Deals' END AS parent_id,
   'expense' AS kind, p_type IN ('ECONOMY','STANDARD') AS essential FROM part
 UNION ALL SELECT 'Goods','Goods',NULL,'expense',false UNION ALL SELECT 'Deals','Deals',NULL,'expense',false
 UNION ALL SELECT 'Income','Income',NULL,'income',false UNION ALL SELECT 'Transfer','Transfer',NULL,'transfer',false),
v_path AS (
 SELECT c.id, c.essential, c.kind, CASE WHEN p.name IS NULL THEN c.name ELSE p.name||' › '||c.name END AS path, coalesce(p.id,c.id) AS top_id
 FROM v_cat c LEFT JOIN v_cat p ON c.parent_id=p.id)
"""
CHARGES = """
v_charges AS (
 SELECT 'E'||CAST(event_id AS VARCHAR) AS id, event_id AS line_no, CAST(ts AS DATE) AS date,
   CAST(-CAST(round(value*100) AS BIGINT) AS BIGINT) AS amount_cents, event_type||'-'||CAST(k%10 AS VARCHAR) AS merchant,
   upper(event_type||' ref #'||CAST(k AS VARCHAR)||' shop') AS description, 'acct-'||CAST(user_id%20 AS VARCHAR) AS account_id,
   'expense' AS direction, CASE WHEN k%10<3 THEN 'Streaming' WHEN k%10<6 THEN 'Groceries' ELSE 'Shopping' END AS category_id
 FROM (SELECT *, CAST(json_extract_string(props,'$.k') AS INTEGER) AS k FROM events WHERE event_type IN ('purchase','click')))
"""
LOG = """
v_log AS (
 SELECT event_id, ts, 'h'||CAST(user_id%20 AS VARCHAR) AS host, event_type AS program,
  event_type||' k='||json_extract_string(props,'$.k')||' from 10.0.0.'||CAST(user_id%8 AS VARCHAR) AS message FROM events)
"""
COUNTERS = """
v_run AS (
 SELECT user_id AS switch, event_type AS port, ts AS t, event_id AS sample, CAST(floor(value) AS BIGINT) AS step,
  CAST(sum(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total
 FROM events),
v_counters AS (
 SELECT switch, port, t, sample, (total*65537)%4294967296 AS rx_ok, (total*3*65537)%4294967296 AS tx_ok, total%7 AS rx_err, total%5 AS tx_err,
  step%11<>0 AS admin, step%4<>0 AS link, 16 AS bits FROM v_run)
"""
PROBES = """
v_probes AS (
 SELECT event_id, ts, 'http://svc'||CAST(user_id%10 AS VARCHAR) AS url,
  CASE event_type WHEN 'error' THEN '000' WHEN 'signup' THEN '503' WHEN 'click' THEN '401' ELSE '200' END AS http_code,
  value/1000 AS seconds, user_id%2=0 AS own_proxy FROM events)
"""
TREE = """
v_tree AS (
 SELECT 'R'||CAST(r_regionkey AS VARCHAR) AS id, r_name AS name, CAST(NULL AS VARCHAR) AS parent_id FROM region
 UNION ALL SELECT 'N'||CAST(n_nationkey AS VARCHAR), n_name, 'R'||CAST(n_regionkey AS VARCHAR) FROM nation
 UNION ALL SELECT 'S'||CAST(s_suppkey AS VARCHAR), s_name, 'N'||CAST(s_nationkey AS VARCHAR) FROM supplier)
"""
