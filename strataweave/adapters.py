"""The canonical tables, derived from the driver's star schema.

Each definition is one SELECT over the raw tables and earlier definitions, written in the SQL that Spark and the
DuckDB oracle share; ``DIV`` and ``HASH16`` stand for what they spell differently. Ids are keys plus one.
"""

from __future__ import annotations

import re

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "conversations", "pages")

VIEWS: dict[str, str] = {
    "mods": """
        SELECT s_suppkey + 1 AS id, s_name AS name, s_suppkey + 1 AS load_order, s_acctbal > 0 AS has_xml,
               s_nationkey % 2 = 0 AS has_dll, concat('1.', CAST(s_nationkey AS STRING)) AS version,
               concat('author', CAST(s_nationkey % 7 AS STRING)) AS author
        FROM supplier""",
    "xml_definitions": """
        SELECT p.p_partkey + 1 AS id, elt5(p.p_partkey, 'item', 'block', 'buff', 'entity_class', 'recipe') AS definition_type,
               concat(replace(p.p_name, ' ', ''), '_', CAST(p.p_partkey AS STRING)) AS name,
               concat(lower(replace(p.p_brand, '#', '')), '.xml') AS file_path, CAST(p.p_size AS BIGINT) AS line_number,
               CASE WHEN p.p_partkey >= 5 THEN concat(replace(q.p_name, ' ', ''), '_', CAST(q.p_partkey AS STRING)) END AS extends
        FROM part p LEFT JOIN part q ON q.p_partkey = DIV(DIV(p.p_partkey, 5), 3) * 5 + p.p_partkey % 5""",
    "xml_properties": """
        SELECT p_partkey * 3 + 1 AS id, p_partkey + 1 AS definition_id, 'Size' AS property_name, CAST(p_size AS STRING) AS property_value,
               CASE WHEN p_size % 3 = 0 THEN 'Action0' END AS property_class FROM part
        UNION ALL SELECT p_partkey * 3 + 2, p_partkey + 1, 'Type', p_type, NULL FROM part
        UNION ALL SELECT p_partkey * 3 + 3, p_partkey + 1, 'Brand', p_brand, NULL FROM part WHERE p_size > 10""",
    "xml_references": """
        SELECT l_orderkey * 8 + l_linenumber AS id, l_partkey + 1 AS source_def_id, s.definition_type AS source_type,
               t.definition_type AS target_type, t.name AS target_name,
               CASE l_returnflag WHEN 'A' THEN 'loot_entry' WHEN 'N' THEN 'recipe_ingredient' ELSE 'triggered_effect:AddBuff' END AS reference_context,
               s.file_path AS file_path, CAST(l_linenumber AS BIGINT) AS line_number
        FROM lineitem JOIN xml_definitions s ON s.id = l_partkey + 1
        JOIN xml_definitions t ON t.id = (l_orderkey * 7 + l_linenumber) % 200 + 1
        WHERE l_linenumber = 1 AND l_quantity >= 45
        UNION ALL
        SELECT l_orderkey * 8 + l_linenumber, l_partkey + 1, s.definition_type, 'entity_group',
               concat('group', CAST(l_suppkey % 40 AS STRING)), 'group_member', s.file_path, CAST(l_linenumber AS BIGINT)
        FROM lineitem JOIN xml_definitions s ON s.id = l_partkey + 1 WHERE l_linenumber = 2 AND l_quantity >= 48""",
    "mod_xml_operations": """
        SELECT id, mod_id, operation, xpath, HASH16(lower(xpath)) AS xpath_hash, lower(xpath) AS xpath_normalized, target_type, target_name,
               property_name, CASE WHEN modifies_operation THEN effect_operation ELSE CAST(qty % 4 AS STRING) END AS new_value,
               file_path, line_number, effect_name, effect_operation, substr(effect_operation, 1, 4) AS effect_value_type,
               CASE WHEN effect_name IS NOT NULL THEN target_type END AS parent_entity,
               CASE WHEN effect_name IS NOT NULL THEN target_name END AS parent_entity_name,
               ln = 3 AS is_triggered_effect, CASE WHEN ln = 3 THEN concat('cvar', CAST(k % 30 AS STRING)) END AS trigger_cvar,
               CASE WHEN ln = 3 THEN elt3(qty, 'set', 'add', 'multiply') END AS trigger_operation, modifies_operation, modifies_value
        FROM (SELECT l_orderkey * 8 + l_linenumber AS id, l_suppkey + 1 AS mod_id, l_partkey AS k, CAST(l_quantity AS BIGINT) AS qty,
                     CAST(l_linenumber AS BIGINT) AS ln,
                     CASE WHEN l_quantity >= 49 THEN 'remove' WHEN l_returnflag = 'A' THEN 'append' WHEN l_returnflag = 'N' THEN 'set' ELSE 'setattribute' END AS operation,
                     concat('/', definition_type, 's/', definition_type, '[@name="', name, '"]/property[@name="prop', CAST(l_linenumber AS STRING), '"]/@value') AS xpath,
                     definition_type AS target_type, name AS target_name,
                     CASE WHEN l_quantity < 49 THEN concat('prop', CAST(l_linenumber AS STRING)) END AS property_name,
                     file_path, CAST(l_orderkey % 1000 AS BIGINT) AS line_number,
                     CASE WHEN l_linenumber = 2 THEN concat('Effect', CAST(l_partkey % 20 AS STRING)) END AS effect_name,
                     CASE WHEN l_linenumber = 2 THEN elt5(CAST(l_quantity AS BIGINT), 'base_set', 'perc_add', 'base_add', 'perc_set', 'base_subtract') END AS effect_operation,
                     l_linenumber = 2 AND CAST(l_quantity AS BIGINT) % 2 = 0 AS modifies_operation,
                     l_linenumber = 2 AND CAST(l_quantity AS BIGINT) % 3 = 0 AS modifies_value
              FROM lineitem JOIN xml_definitions ON id = l_partkey + 1 WHERE l_linenumber <= 3) o""",
    "csharp_deps": """
        SELECT o_orderkey + 1 AS id, o_custkey % ns + 1 AS mod_id,
               elt5(o_orderkey, 'item', 'harmony_class', 'buff', 'extends_class', 'entity_class') AS dependency_type, d.name AS dependency_name,
               concat('src', CAST(o_orderkey % 50 AS STRING), '.cs') AS source_file, o_orderkey % 400 AS line_number
        FROM orders CROSS JOIN (SELECT count(*) AS np FROM part) cp CROSS JOIN (SELECT count(*) AS ns FROM supplier) cs
        JOIN xml_definitions d ON d.id = o_orderkey * 3 % np + 1""",
    "harmony_patches": """
        SELECT l_orderkey + 1 AS id, l_suppkey + 1 AS mod_id, concat('Patch', CAST(l_orderkey % 97 AS STRING)) AS patch_class,
               concat('Class', CAST(l_partkey % 50 AS STRING)) AS target_class, concat('M', CAST(l_orderkey % 20 AS STRING)) AS target_method,
               CASE l_returnflag WHEN 'A' THEN 'Prefix' WHEN 'N' THEN 'Postfix' ELSE 'Transpiler' END AS patch_type,
               CASE WHEN l_suppkey % 2 = 0 THEN '["int"]' ELSE '["int","string"]' END AS target_arg_types,
               CASE WHEN CAST(l_quantity AS BIGINT) % 10 = 0 THEN 800 WHEN CAST(l_quantity AS BIGINT) % 10 = 1 THEN 100 ELSE 400 END AS harmony_priority,
               CASE WHEN CAST(l_quantity AS BIGINT) % 5 = 1 THEN concat('["', s_name, '"]') END AS harmony_before,
               CASE WHEN CAST(l_quantity AS BIGINT) % 5 = 2 THEN concat('["', s_name, '"]') END AS harmony_after,
               l_returnflag = 'A' AND l_linestatus = 'F' AS returns_bool, l_quantity >= 48 AS is_guarded,
               CASE WHEN l_quantity >= 48 THEN concat('guard', CAST(l_suppkey % 9 AS STRING)) END AS guard_condition
        FROM lineitem CROSS JOIN (SELECT count(*) AS ns FROM supplier) cs LEFT JOIN supplier ON s_suppkey = (l_suppkey + 1) % ns WHERE l_linenumber = 1 AND l_quantity >= 40""",
    "class_inheritance": """
        SELECT concat('Class', CAST(p_partkey AS STRING)) AS class_name,
               CASE WHEN p_partkey > 0 THEN concat('Class', CAST(DIV(p_partkey, 2) AS STRING)) END AS parent_class, p_partkey % 4 = 0 AS is_abstract
        FROM part""",
    "types": """
        SELECT CAST(n_nationkey + 1 AS BIGINT) AS id, concat('Type', CAST(n_nationkey + 1 AS STRING)) AS name, concat('NS', CAST(n_regionkey AS STRING)) AS namespace,
               concat('NS', CAST(n_regionkey AS STRING), '.Type', CAST(n_nationkey + 1 AS STRING)) AS full_name,
               CASE WHEN n_nationkey >= 5 THEN concat('Type', CAST(DIV(n_nationkey, 3) + 1 AS STRING)) END AS base_type,
               concat('Asm', CAST(n_regionkey AS STRING)) AS assembly
        FROM nation""",
    "methods": """
        SELECT p_partkey + 1 AS id, p_partkey % 25 + 1 AS type_id,
               CASE p_partkey % 7 WHEN 0 THEN 'Update' WHEN 1 THEN 'LateUpdate' ELSE concat('M', CAST(p_partkey % 200 AS STRING)) END AS name,
               concat('(', p_type, ')') AS signature, p_partkey % 3 = 0 AS is_virtual, p_partkey % 4 = 0 AS is_override, p_partkey % 25 = 0 AS is_abstract,
               concat('Type', CAST(p_partkey % 25 + 1 AS STRING), '.cs') AS file_path, CAST(p_size AS BIGINT) AS line_number
        FROM part""",
    "calls": """
        SELECT l_partkey + 1 AS caller_id, (l_partkey * 3 + l_linenumber + 1) % np + 1 AS callee_id,
               CAST(min(l_orderkey % 900) AS BIGINT) AS line_number, CASE WHEN l_linenumber = 1 THEN 'direct' ELSE 'virtual' END AS call_type
        FROM lineitem CROSS JOIN (SELECT count(*) AS np FROM part) cp
        WHERE l_linenumber <= 2 AND l_quantity >= 25 GROUP BY l_partkey, l_linenumber, np""",
    "external_calls": """
        SELECT l_partkey + 1 AS caller_id, concat('Ext', CAST(l_suppkey % 3 AS STRING)) AS target_assembly,
               elt5(l_suppkey, 'GameObject', 'Object', 'String', 'Enumerable', 'Component') AS target_type,
               elt5(l_suppkey, 'GetComponent', 'FindObjectOfType', 'Format', 'Where', 'GetComponents') AS target_method,
               l_orderkey % 700 AS line_number
        FROM lineitem WHERE l_linenumber = 3 AND l_quantity >= 25""",
    "method_bodies": "SELECT doc_id + 1 AS method_id, text AS body FROM documents",
    "event_fires": """
        SELECT event_id AS id, event_type AS event_name, concat('Owner', CAST(user_id AS STRING)) AS owner_type,
               concat('Type', CAST(user_id % 25 + 1 AS STRING)) AS firer_type, value > 100 AS is_conditional, user_id % 2 = 1 AS is_mod, event_id % 500 AS line_number,
               CASE WHEN user_id % 2 = 1 THEN CAST(user_id % 10 + 1 AS BIGINT) END AS mod_id
        FROM events WHERE event_id % 2 = 0""",
    "event_subscriptions": """
        SELECT event_id AS id, event_type AS event_name, concat('Owner', CAST(user_id AS STRING)) AS owner_type,
               concat('Class', CAST(event_id % 50 AS STRING)) AS subscriber_type, concat('M', CAST(event_id % 20 AS STRING)) AS handler_method,
               CASE WHEN value > 50 THEN 'subscribe' ELSE 'unsubscribe' END AS subscription_type, user_id % 3 = 1 AS is_mod, event_id % 500 AS line_number
        FROM events WHERE event_id % 2 = 1""",
    "event_declarations": """
        SELECT min(event_id) AS id, event_type AS event_name, concat('Owner', CAST(user_id AS STRING)) AS owner_type,
               concat('Action<', event_type, '>') AS delegate_type, user_id % 2 = 1 AS is_mod
        FROM events GROUP BY event_type, user_id""",
    "game_code_analysis": """
        SELECT d.doc_id + 1 AS id, elt5(d.doc_id, 'unimplemented', 'empty_catch', 'todo', 'stub_method', 'hardcoded_entity') AS analysis_type,
               concat(elt5(d.doc_id + DIV(d.doc_id, 5), 'ItemClass', 'BlockManager', 'EntityPlayer', 'BuffDebug', 'RandomThing'), CASE WHEN d.doc_id % 9 = 0 THEN 'Test' ELSE '' END) AS class_name,
               concat('M', CAST(d.doc_id % 200 AS STRING)) AS method_name,
               CASE WHEN l.toxic = 1 THEN 'BUG' WHEN l.quality = 0 THEN 'WARNING' WHEN l.quality = 1 THEN 'INFO' ELSE 'OPPORTUNITY' END AS severity,
               elt3(d.doc_id, 'high', 'medium', 'low') AS confidence,
               concat('Finding in ', d.source, CASE WHEN d.doc_id % 11 = 0 THEN ' (Unreachable recipe code)' WHEN d.doc_id % 7 = 0 THEN ' with player inventory' ELSE '' END) AS description,
               concat(d.source, '.cs') AS file_path, d.n_chars % 500 AS line_number, CAST(NULL AS STRING) AS related_entities
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "stored_hashes": """
        SELECT concat('File', CAST(p_partkey AS STRING), '.xml') AS file_path, HASH16(p_name) AS content_hash FROM part WHERE p_partkey % 10 <> 0""",
    "current_hashes": """
        SELECT concat('file', CAST(p_partkey AS STRING), '.XML') AS file_path,
               CASE WHEN p_partkey % 5 = 0 THEN HASH16(p_type) ELSE HASH16(p_name) END AS content_hash
        FROM part WHERE p_partkey % 7 <> 0""",
    "semantic_mappings": """
        SELECT 'property_name' AS entity_type, 'Size' AS entity_name, 'how large it is' AS layman_description, 'number' AS technical_description
        UNION ALL SELECT 'definition_type', 'item', 'a thing to carry', 'entity'""",
}


def _macros(sql: str, duck: bool) -> str:
    for name, n in (("elt5", 5), ("elt3", 3)):  # the k-th of n strings, by remainder
        while (at := sql.find(name + "(")) >= 0:
            parts, depth, begin = [], 0, at + len(name) + 1
            for i in range(begin, len(sql)):
                c = sql[i]
                if c == "," and not depth or c == ")" and not depth:
                    parts.append(sql[begin:i].strip())
                    begin = i + 1
                    if c == ")":
                        break
                depth += (c == "(") - (c == ")")
            cases = " ".join(f"WHEN {k} THEN {p}" for k, p in enumerate(parts[1:]))
            sql = sql[:at] + f"CASE ({parts[0]}) % {n} {cases} END" + sql[begin:]
    while m := re.search(r"DIV\(([^(),]*(?:\([^()]*\))?[^(),]*), ([^(),]*)\)", sql):
        sql = sql[: m.start()] + f"(({m[1]}) {'//' if duck else 'div'} ({m[2]}))" + sql[m.end() :]
    hashed = r"substr(sha256(\1), 1, 16)" if duck else r"substr(sha2(\1, 256), 1, 16)"
    return re.sub(r"HASH16\(((?:[^()]|\([^()]*\))*)\)", hashed, sql)


def needed(sql: str) -> list[str]:
    """Views that ``sql`` names, with what they need, in order of definition."""
    found, open_ = set(), [sql]
    while open_:
        text = open_.pop()
        for v in VIEWS.keys() - found:
            if re.search(rf"\b{v}\b", text):
                found.add(v)
                open_.append(VIEWS[v])
    return [v for v in VIEWS if v in found]


def spark_sql(view: str, sf_dir: str) -> str:
    """Spark SQL that reads ``view`` from the files below ``sf_dir``."""
    sql = ", ".join(f"{v} AS ({_macros(VIEWS[v], False)})" for v in needed(view))
    raw = re.sub(r"\b(FROM|JOIN) (" + "|".join(RAW) + r")\b", lambda m: f"{m[1]} parquet.`{sf_dir}/{m[2]}.parquet` AS {m[2]}", sql)
    raw = re.sub(r"` AS (\w+) (?!LEFT|JOIN|WHERE|GROUP|ON|UNION|INNER)([a-z])\b", r"` AS \2", raw)  # an alias of its own
    return f"WITH {raw} SELECT * FROM {view}"


def oracle(sql: str) -> str:
    """``sql`` over the canonical tables as DuckDB SQL over the raw ones."""
    sql = _macros(sql.strip(), True)
    views = ", ".join(f"{v} AS ({_macros(VIEWS[v], True)})" for v in needed(sql))
    recursive = "RECURSIVE " if re.match(r"(?i)with recursive", sql) else ""
    body = re.sub(r"(?i)^with (recursive )?", "", sql) if re.match(r"(?i)with\b", sql) else None
    if not views:
        return sql
    return f"WITH {recursive}{views}, {body}" if body is not None else f"WITH {views} {sql}"
