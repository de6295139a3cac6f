"""The domain frames of sources.tables as SQL, for the queries' SQL forms."""

NET = "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,2))"
DIV = "CASE c_mktsegment WHEN 'BUILDING' THEN 'PI' WHEN 'AUTOMOBILE' THEN 'ICI' WHEN 'MACHINERY' THEN 'PP' WHEN 'FURNITURE' THEN 'EL' WHEN 'HOUSEHOLD' THEN 'LM' ELSE '' END"


def branch(name: str, tasik: str = "Tasik", digits: str = r"(\d{2})$") -> str:
    n = f"TRY_CAST(regexp_extract(upper(trim({name})), '{digits}', 1) AS INTEGER)"
    return f"""CASE WHEN {n} BETWEEN 30 AND 39 THEN 'Project' WHEN {n} BETWEEN 50 AND 59 THEN 'Agen' WHEN {n} BETWEEN 0 AND 19 THEN 'Bandung' WHEN {n} BETWEEN 20 AND 29 THEN 'PCK' WHEN {n} BETWEEN 60 AND 69 THEN 'Cirebon' WHEN {n} BETWEEN 70 AND 79 THEN '{tasik}' WHEN {n} BETWEEN 80 AND 89 THEN 'Bogor' ELSE 'Project' END"""


INV = f"""inv AS (SELECT CAST(l_shipdate AS DATE) AS invoice_date, l_orderkey AS invoice_code, c_custkey AS customer_code, c_name AS customer_name, {DIV} AS division, s_name AS salesman, {branch("s_name")} AS branch, lower(p_brand) AS sku, p_type AS category, p_name AS product_name, p_partkey AS product_code, CAST(l_quantity AS DECIMAL(18,2)) AS qty, {NET} AS net, CAST(CAST(l_quantity AS DECIMAL(18,2)) * p_size AS DECIMAL(18,2)) AS volume, l_returnflag AS status
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""
SO = f"""so AS (SELECT o_orderkey AS so_code, o_custkey AS customer_code, {DIV} AS division, 'SLP' || lpad(CAST(o_orderkey % 90 AS VARCHAR), 2, '0') AS salesman, CAST(o_orderdate AS DATE) AS order_date,
 CASE WHEN o_orderkey % 11 = 3 THEN 'Cancelled' WHEN o_orderkey % 13 = 5 THEN 'Closed' WHEN starts_with(o_orderpriority, '4') THEN 'Draft' WHEN starts_with(o_orderpriority, '5') THEN 'On Hold' WHEN o_orderstatus = 'F' THEN 'Done' WHEN o_orderstatus = 'P' THEN 'Done-Partial' ELSE 'Open' END AS so_status,
 CAST(o_totalprice AS DECIMAL(18,2)) AS so_value, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CASE WHEN o_orderkey % 4 = 0 THEN 0.5 ELSE 1.0 END AS DECIMAL(18,2)) AS delivery_value
 FROM orders JOIN customer ON o_custkey = c_custkey)"""
PACK = f"pack AS (SELECT l_orderkey AS so_code, CAST(l_shipdate AS DATE) AS printed_date, {NET} AS net FROM lineitem WHERE l_linestatus = 'F')"
BILL = f"""bill AS (SELECT l_orderkey AS so_code, l_orderkey AS invoice_code, CAST(l_shipdate AS DATE) AS invoice_date, CAST(l_shipdate AS DATE) + 30 AS due_date, CASE WHEN l_returnflag = 'A' THEN CAST(l_shipdate AS DATE) + 20 END AS paid_date, {NET} AS net, CASE WHEN l_returnflag = 'A' THEN {NET} ELSE CAST(0 AS DECIMAL(18,2)) END AS paid, CASE WHEN l_returnflag = 'A' THEN 'Done' ELSE 'Open' END AS invoice_status FROM lineitem WHERE l_returnflag IN ('A', 'N'))"""
BUY = "buy AS (SELECT event_id, user_id AS customer, CAST(ts AS DATE) AS date, CAST(value AS DECIMAL(18,2)) AS value, event_id % 37 AS sku FROM events WHERE event_type = 'purchase')"
GIFT = "gift AS (SELECT event_id, user_id AS customer, CAST(ts AS DATE) AS date, event_id % 7 AS program, user_id % 5 AS branch FROM events WHERE event_type = 'signup')"
VISIT = "visit AS (SELECT 'S' || CAST(user_id % 20 AS VARCHAR) AS salesman, CAST(ts AS DATE) AS visit_date, CASE WHEN user_id % 9 = 0 THEN NULL ELSE 'B' || CAST(user_id % 4 AS VARCHAR) END AS branch, CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS status FROM events)"
CAT = "cat AS (SELECT p_partkey AS row_id, upper(p_name || ' ' || p_brand || ' ' || CAST(p_size AS VARCHAR) || 'MM') AS name, 'P-' || CAST(p_partkey AS VARCHAR) AS code, p_brand AS brand, CAST(p_retailprice AS DECIMAL(18,2)) AS price, p_size AS size FROM part)"
VEND = """vend AS (SELECT p_partkey AS row_id, CASE WHEN p_partkey % 3 = 0 THEN p_name || '-' || p_brand || '-' || CAST(p_size AS VARCHAR) || ' mm' ELSE p_brand || '  ' || p_name || '  ' || CAST(p_size AS VARCHAR) || 'MM' END AS name, CASE WHEN p_partkey % 5 = 0 THEN 'P' || CAST(p_partkey AS VARCHAR) END AS code, p_brand AS brand,
 CAST(CAST(p_retailprice AS DECIMAL(18,2)) * CASE WHEN p_partkey % 10 = 0 THEN 1.10::DECIMAL(3,2) WHEN p_partkey % 14 = 0 THEN 0.95::DECIMAL(3,2) WHEN p_partkey % 202 = 0 THEN 2.20::DECIMAL(3,2) ELSE 1.00::DECIMAL(3,2) END AS DECIMAL(18,2)) AS price, CAST(p_partkey % 60 AS DOUBLE) AS qty FROM part WHERE p_partkey % 2 = 0)"""
