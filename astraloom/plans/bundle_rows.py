"""What the queries of `plans.bundles` find in one service, row by row, with @K@ for its key; derived by hand from the rules' definitions and the texts of `sources.bundles`."""

# fmt: off
ROWS: dict[str, tuple[str, list[tuple]]] = {
    "service_nodes": ("id string, type string, line_start bigint, line_end bigint, docstring string, decorators string, tables string, n_routes bigint, parent_id string, complexity bigint, is_stub boolean", [
        ('class:svc@K@/db.py:Repo_@K@', 'class', 9, 11, '', '', '', 0, 'file:svc@K@/db.py', 0, False),
        ('class:svc@K@/items.py:Item_@K@', 'class', 1, 4, '', '', '', 0, 'file:svc@K@/items.py', 0, False),
        ('class:svc@K@/models.py:Line_@K@', 'class', 6, 7, 'A line.', '', '', 0, 'file:svc@K@/models.py', 0, False),
        ('class:svc@K@/models.py:Order_@K@', 'class', 2, 5, '', '', '', 0, 'file:svc@K@/models.py', 0, False),
        ('file:svc@K@/__init__.py', 'file', 1, 2, 'Service @K@.', '', '', 0, '', 0, False),
        ('file:svc@K@/api.py', 'file', 1, 13, '', '', '', 2, '', 0, False),
        ('file:svc@K@/config.py', 'file', 1, 1, '', '', '', 0, '', 0, False),
        ('file:svc@K@/db.py', 'file', 1, 15, '', '', '', 0, '', 0, False),
        ('file:svc@K@/envy.py', 'file', 1, 7, '', '', '', 0, '', 0, False),
        ('file:svc@K@/half.py', 'file', 1, 3, '', '', '', 0, '', 0, False),
        ('file:svc@K@/idle.py', 'file', 1, 3, '', '', '', 0, '', 0, False),
        ('file:svc@K@/items.py', 'file', 1, 4, '', '', 'items_@K@', 0, '', 0, False),
        ('file:svc@K@/jobs/helper.py', 'file', 1, 11, '', '', '', 0, '', 0, False),
        ('file:svc@K@/link_checker.py', 'file', 1, 3, '', '', '', 0, '', 0, False),
        ('file:svc@K@/main.py', 'file', 1, 13, 'Entry of @K@.', '', '', 4, '', 0, False),
        ('file:svc@K@/models.py', 'file', 1, 12, 'Models of @K@.', '', 'orders_@K@,items_@K@ (via Item_@K@)', 0, '', 0, False),
        ('file:svc@K@/text/alt.py', 'file', 1, 2, '', '', '', 0, '', 0, False),
        ('file:svc@K@/text/helper.py', 'file', 1, 2, '', '', '', 0, '', 0, False),
        ('file:svc@K@/tools/run.py', 'file', 1, 5, '', '', '', 0, '', 0, False),
        ('file:svc@K@/typed.py', 'file', 1, 2, '', '', '', 0, '', 0, False),
        ('func:svc@K@/api.py:both_@K@', 'function', 12, 13, '', 'router.route', '', 0, 'file:svc@K@/api.py', 1, False),
        ('func:svc@K@/api.py:create_@K@', 'function', 5, 10, '', 'router.post,audit', '', 0, 'file:svc@K@/api.py', 2, False),
        ('func:svc@K@/db.py:Repo_@K@.risky_@K@', 'function', 10, 11, '', '', '', 0, 'class:svc@K@/db.py:Repo_@K@', 1, False),
        ('func:svc@K@/db.py:find_@K@', 'function', 7, 8, '', '', '', 0, 'file:svc@K@/db.py', 1, False),
        ('func:svc@K@/db.py:get_db', 'function', 12, 13, '', '', '', 0, 'file:svc@K@/db.py', 1, False),
        ('func:svc@K@/db.py:get_session', 'function', 14, 15, '', '', '', 0, 'file:svc@K@/db.py', 1, False),
        ('func:svc@K@/db.py:save_@K@', 'function', 1, 6, '', '', '', 0, 'file:svc@K@/db.py', 3, False),
        ('func:svc@K@/envy.py:many_@K@', 'function', 1, 7, '', '', '', 0, 'file:svc@K@/envy.py', 1, False),
        ('func:svc@K@/half.py:wait_@K@', 'function', 2, 3, '', '', '', 0, 'file:svc@K@/half.py', 1, False),
        ('func:svc@K@/idle.py:rest_@K@', 'function', 2, 3, '', '', '', 0, 'file:svc@K@/idle.py', 1, False),
        ('func:svc@K@/items.py:Item_@K@.total_@K@', 'function', 3, 4, '', '', '', 0, 'class:svc@K@/items.py:Item_@K@', 4, False),
        ('func:svc@K@/jobs/helper.py:expire_@K@', 'function', 3, 5, '', '', '', 0, 'file:svc@K@/jobs/helper.py', 1, False),
        ('func:svc@K@/jobs/helper.py:retry_@K@', 'function', 6, 11, '', '', '', 0, 'file:svc@K@/jobs/helper.py', 2, False),
        ('func:svc@K@/link_checker.py:check_@K@', 'function', 2, 3, '', '', '', 0, 'file:svc@K@/link_checker.py', 1, False),
        ('func:svc@K@/main.py:ping_@K@', 'function', 12, 13, '', 'app.get', '', 0, 'file:svc@K@/main.py', 1, False),
        ('func:svc@K@/models.py:stub_@K@', 'function', 10, 12, 'Nothing.', '', '', 0, 'file:svc@K@/models.py', 1, True),
        ('func:svc@K@/text/alt.py:store_@K@', 'function', 1, 2, '', '', '', 0, 'file:svc@K@/text/alt.py', 1, False),
        ('func:svc@K@/text/helper.py:cap_@K@', 'function', 1, 2, '', '', '', 0, 'file:svc@K@/text/helper.py', 1, False),
        ('func:svc@K@/tools/run.py:dispatch_@K@', 'function', 2, 5, '', '', '', 0, 'file:svc@K@/tools/run.py', 1, False),
    ]),
    "service_edges": ("source string, target string, type string, flags string, alias string, line bigint", [
        ('class:svc@K@/items.py:Item_@K@', 'class_ref:Model', 'inheritance', '', '', 1),
        ('class:svc@K@/models.py:Line_@K@', 'class_ref:mixins.Part', 'inheritance', '', '', 6),
        ('file:svc@K@/__init__.py', 'module:models.Order_@K@', 'import', '', '', 2),
        ('file:svc@K@/api.py', 'file:svc@K@/db.py', 'import', '', 'store', 2),
        ('file:svc@K@/api.py', 'file:svc@K@/models.py', 'import', '', '', 1),
        ('file:svc@K@/api.py', 'file:svc@K@/models.py', 'import', '', '', 1),
        ('file:svc@K@/api.py', 'func:svc@K@/db.py:save_@K@', 'call', '', '', 10),
        ('file:svc@K@/api.py', 'module:json', 'import', 'function_scope,conditional', '', 7),
        ('file:svc@K@/envy.py', 'func:svc@K@/db.py:save_@K@', 'call', '', '', 2),
        ('file:svc@K@/envy.py', 'func:svc@K@/db.py:save_@K@', 'call', '', '', 3),
        ('file:svc@K@/envy.py', 'func:svc@K@/db.py:save_@K@', 'call', '', '', 4),
        ('file:svc@K@/envy.py', 'func:svc@K@/db.py:save_@K@', 'call', '', '', 5),
        ('file:svc@K@/envy.py', 'func:svc@K@/db.py:save_@K@', 'call', '', '', 6),
        ('file:svc@K@/envy.py', 'func:svc@K@/db.py:save_@K@', 'call', '', '', 7),
        ('file:svc@K@/half.py', 'file:svc@K@/idle.py', 'import', 'dynamic', '', 1),
        ('file:svc@K@/jobs/helper.py', 'file:svc@K@/db.py', 'import', '', '', 1),
        ('file:svc@K@/jobs/helper.py', 'file:svc@K@/models.py', 'import', '', '', 2),
        ('file:svc@K@/jobs/helper.py', 'func:svc@K@/db.py:Repo_@K@.risky_@K@', 'call', '', '', 8),
        ('file:svc@K@/jobs/helper.py', 'func:svc@K@/db.py:save_@K@', 'call', '', '', 10),
        ('file:svc@K@/link_checker.py', 'func:svc@K@/db.py:save_@K@', 'call', '', '', 3),
        ('file:svc@K@/main.py', 'file:svc@K@/api.py', 'import', '', '', 3),
        ('file:svc@K@/main.py', 'file:svc@K@/api.py', 'import', '', 'orders', 4),
        ('file:svc@K@/main.py', 'file:svc@K@/db.py', 'import', '', '', 5),
        ('file:svc@K@/main.py', 'file:svc@K@/half.py', 'import', '', '', 6),
        ('file:svc@K@/main.py', 'module:fastapi.FastAPI', 'import', '', '', 2),
        ('file:svc@K@/tools/run.py', 'module:asyncio', 'import', '', '', 1),
        ('file:svc@K@/typed.py', 'module:__future__.annotations', 'import', '', '', 1),
    ]),
    "service_routes": ("path string, method string, route string, handler string, line bigint, type string, prefix string, warning string", [
        ('svc@K@/api.py', 'GET/POST', '/both', 'both_@K@', 12, 'route', '', ''),
        ('svc@K@/api.py', 'POST', '/orders', 'create_@K@', 5, 'route', '', ''),
        ('svc@K@/main.py', '', '', '', 10, 'include_router', '<dynamic>', 'include_router prefix is dynamic'),
        ('svc@K@/main.py', '', '', '', 8, 'include_router', '/s@K@', ''),
        ('svc@K@/main.py', '', '', '', 9, 'include_router', '', 'include_router called without prefix'),
        ('svc@K@/main.py', 'GET', '/ping', 'ping_@K@', 12, 'route', '', ''),
    ]),
    "service_connectivity": ("path string, status string, dead_confidence bigint", [
        ('svc@K@/__init__.py', 'reachable', 0),
        ('svc@K@/api.py', 'reachable', 0),
        ('svc@K@/config.py', 'unreachable', 100),
        ('svc@K@/db.py', 'incomplete', 40),
        ('svc@K@/envy.py', 'unreachable', 100),
        ('svc@K@/half.py', 'incomplete', 40),
        ('svc@K@/idle.py', 'incomplete', 40),
        ('svc@K@/items.py', 'unreachable', 100),
        ('svc@K@/jobs/helper.py', 'unreachable', 100),
        ('svc@K@/link_checker.py', 'unreachable', 100),
        ('svc@K@/main.py', 'reachable', 0),
        ('svc@K@/models.py', 'reachable', 0),
        ('svc@K@/text/alt.py', 'unreachable', 100),
        ('svc@K@/text/helper.py', 'unreachable', 100),
        ('svc@K@/tools/run.py', 'reachable', 0),
        ('svc@K@/typed.py', 'unreachable', 100),
    ]),
    "service_connectivity_from_entry": ("path string, status string, dead_confidence bigint", [
        ('svc@K@/__init__.py', 'reachable', 0),
        ('svc@K@/api.py', 'unreachable', 80),
        ('svc@K@/config.py', 'unreachable', 100),
        ('svc@K@/db.py', 'incomplete', 40),
        ('svc@K@/envy.py', 'unreachable', 100),
        ('svc@K@/half.py', 'unreachable', 80),
        ('svc@K@/idle.py', 'unreachable', 80),
        ('svc@K@/items.py', 'unreachable', 100),
        ('svc@K@/jobs/helper.py', 'reachable', 0),
        ('svc@K@/link_checker.py', 'unreachable', 100),
        ('svc@K@/main.py', 'unreachable', 100),
        ('svc@K@/models.py', 'reachable', 0),
        ('svc@K@/text/alt.py', 'unreachable', 100),
        ('svc@K@/text/helper.py', 'unreachable', 100),
        ('svc@K@/tools/run.py', 'reachable', 0),
        ('svc@K@/typed.py', 'unreachable', 100),
    ]),
    "service_usage": ("path string, name string, type string, line bigint, n_imported bigint, n_called bigint, n_referenced bigint, n_dependents bigint, internal boolean", [
        ('svc@K@/api.py', 'both_@K@', 'function', 12, 0, 1, 0, 1, False),
        ('svc@K@/api.py', 'create_@K@', 'function', 5, 0, 0, 0, 0, False),
        ('svc@K@/config.py', 'MODE_@K@', 'constant', 1, 0, 0, 0, 0, False),
        ('svc@K@/db.py', 'Repo_@K@', 'class', 9, 0, 0, 0, 0, False),
        ('svc@K@/db.py', 'find_@K@', 'function', 7, 0, 0, 0, 0, False),
        ('svc@K@/db.py', 'get_db', 'function', 12, 0, 0, 0, 0, False),
        ('svc@K@/db.py', 'get_session', 'function', 14, 0, 0, 0, 0, False),
        ('svc@K@/db.py', 'risky_@K@', 'function', 10, 0, 1, 0, 1, False),
        ('svc@K@/db.py', 'save_@K@', 'function', 1, 1, 9, 0, 4, False),
        ('svc@K@/envy.py', 'many_@K@', 'function', 1, 0, 0, 0, 0, False),
        ('svc@K@/half.py', 'wait_@K@', 'function', 2, 0, 0, 0, 0, False),
        ('svc@K@/idle.py', 'IDLE_@K@', 'constant', 1, 0, 0, 0, 0, False),
        ('svc@K@/idle.py', 'rest_@K@', 'function', 2, 0, 0, 0, 0, False),
        ('svc@K@/items.py', 'Item_@K@', 'class', 1, 0, 0, 0, 0, False),
        ('svc@K@/items.py', 'total_@K@', 'function', 3, 0, 0, 0, 0, False),
        ('svc@K@/jobs/helper.py', 'expire_@K@', 'function', 3, 0, 0, 0, 0, False),
        ('svc@K@/jobs/helper.py', 'retry_@K@', 'function', 6, 0, 0, 0, 0, False),
        ('svc@K@/link_checker.py', 'MAX_RETRIES', 'constant', 1, 0, 0, 0, 0, False),
        ('svc@K@/link_checker.py', 'check_@K@', 'function', 2, 0, 0, 0, 0, False),
        ('svc@K@/main.py', 'app', 'variable', 7, 0, 0, 0, 0, True),
        ('svc@K@/main.py', 'ping_@K@', 'function', 12, 0, 0, 0, 0, False),
        ('svc@K@/models.py', 'LIMIT_@K@', 'constant', 8, 2, 0, 1, 2, False),
        ('svc@K@/models.py', 'Line_@K@', 'class', 6, 0, 0, 0, 0, False),
        ('svc@K@/models.py', 'Order_@K@', 'class', 2, 2, 0, 0, 2, False),
        ('svc@K@/models.py', 'default_@K@', 'variable', 9, 0, 0, 1, 0, False),
        ('svc@K@/models.py', 'stub_@K@', 'function', 10, 0, 0, 0, 0, False),
        ('svc@K@/text/alt.py', 'store_@K@', 'function', 1, 0, 0, 0, 0, False),
        ('svc@K@/text/helper.py', 'cap_@K@', 'function', 1, 0, 0, 0, 0, False),
        ('svc@K@/tools/run.py', 'dispatch_@K@', 'function', 2, 0, 0, 0, 0, False),
    ]),
    "service_users": ("path string, name string, how string, file string, line bigint", [
        ('svc@K@/api.py', 'both_@K@', 'called', 'svc@K@/main.py', 13),
        ('svc@K@/db.py', 'risky_@K@', 'called', 'svc@K@/jobs/helper.py', 8),
        ('svc@K@/db.py', 'save_@K@', 'called', 'svc@K@/api.py', 10),
        ('svc@K@/db.py', 'save_@K@', 'called', 'svc@K@/envy.py', 2),
        ('svc@K@/db.py', 'save_@K@', 'called', 'svc@K@/jobs/helper.py', 10),
        ('svc@K@/db.py', 'save_@K@', 'imported', 'svc@K@/jobs/helper.py', 1),
        ('svc@K@/models.py', 'LIMIT_@K@', 'imported', 'svc@K@/api.py', 1),
        ('svc@K@/models.py', 'LIMIT_@K@', 'imported', 'svc@K@/jobs/helper.py', 2),
        ('svc@K@/models.py', 'Order_@K@', 'imported', 'svc@K@/__init__.py', 2),
        ('svc@K@/models.py', 'Order_@K@', 'imported', 'svc@K@/api.py', 1),
    ]),
    "service_xref_findings": ("rule string, severity string, path string, line bigint, symbol string", [
        ('XREF_DUPLICATE_FUNCTION', 'med', 'svc@K@/db.py', 1, 'save_@K@'),
        ('XREF_DUPLICATE_FUNCTION', 'med', 'svc@K@/jobs/helper.py', 3, 'expire_@K@'),
        ('XREF_DUPLICATE_FUNCTION', 'med', 'svc@K@/tools/run.py', 2, 'dispatch_@K@'),
        ('XREF_UNUSED_CONSTANT', 'low', 'svc@K@/config.py', 1, 'MODE_@K@'),
        ('XREF_UNUSED_CONSTANT', 'low', 'svc@K@/idle.py', 1, 'IDLE_@K@'),
        ('XREF_UNUSED_CONSTANT', 'low', 'svc@K@/link_checker.py', 1, 'MAX_RETRIES'),
        ('XREF_UNUSED_SYMBOL', 'med', 'svc@K@/db.py', 7, 'find_@K@'),
        ('XREF_UNUSED_SYMBOL', 'med', 'svc@K@/db.py', 9, 'Repo_@K@'),
        ('XREF_UNUSED_SYMBOL', 'med', 'svc@K@/envy.py', 1, 'many_@K@'),
        ('XREF_UNUSED_SYMBOL', 'med', 'svc@K@/half.py', 2, 'wait_@K@'),
        ('XREF_UNUSED_SYMBOL', 'med', 'svc@K@/idle.py', 2, 'rest_@K@'),
        ('XREF_UNUSED_SYMBOL', 'med', 'svc@K@/items.py', 1, 'Item_@K@'),
        ('XREF_UNUSED_SYMBOL', 'med', 'svc@K@/items.py', 3, 'total_@K@'),
        ('XREF_UNUSED_SYMBOL', 'med', 'svc@K@/jobs/helper.py', 3, 'expire_@K@'),
        ('XREF_UNUSED_SYMBOL', 'med', 'svc@K@/jobs/helper.py', 6, 'retry_@K@'),
        ('XREF_UNUSED_SYMBOL', 'med', 'svc@K@/link_checker.py', 2, 'check_@K@'),
        ('XREF_UNUSED_SYMBOL', 'med', 'svc@K@/models.py', 10, 'stub_@K@'),
        ('XREF_UNUSED_SYMBOL', 'med', 'svc@K@/models.py', 6, 'Line_@K@'),
        ('XREF_UNUSED_SYMBOL', 'med', 'svc@K@/text/alt.py', 1, 'store_@K@'),
        ('XREF_UNUSED_SYMBOL', 'med', 'svc@K@/text/helper.py', 1, 'cap_@K@'),
        ('XREF_UNUSED_SYMBOL', 'med', 'svc@K@/tools/run.py', 2, 'dispatch_@K@'),
    ]),
    "service_feature_envy_intent": ("rule string, path string, line bigint, symbol string", [
        ('XREF_FEATURE_ENVY_INTENT', 'svc@K@/envy.py', 1, 'svc@K@/db.py'),
    ]),
    "service_blocks": ("name string, members string, shared_tables string, shared_imports string", [
        ('Svc@K@', 'file:svc@K@/api.py,file:svc@K@/db.py,file:svc@K@/half.py,file:svc@K@/idle.py,file:svc@K@/jobs/helper.py,file:svc@K@/main.py,file:svc@K@/models.py', '', 'file:svc@K@/api.py,file:svc@K@/db.py,file:svc@K@/models.py'),
    ]),
    "service_view_blocks": ("name string, is_tests boolean, members string", [
        ('Svc@K@ / svc@K@', False, 'file:svc@K@/api.py,file:svc@K@/db.py,file:svc@K@/half.py,file:svc@K@/idle.py,file:svc@K@/jobs/helper.py,file:svc@K@/main.py,file:svc@K@/models.py'),
    ]),
    "service_block_totals": ("first string, files bigint, high bigint, med bigint, low bigint", [
        ('file:svc@K@/api.py', 7, 0, 0, 5),
    ]),
    "service_file_view": ("path string, complexity bigint, n_imports bigint, n_imported_by bigint", [
        ('svc@K@/__init__.py', 1, 0, 0),
        ('svc@K@/api.py', 3, 2, 1),
        ('svc@K@/config.py', 1, 0, 0),
        ('svc@K@/db.py', 6, 0, 3),
        ('svc@K@/envy.py', 1, 0, 0),
        ('svc@K@/half.py', 1, 1, 1),
        ('svc@K@/idle.py', 1, 0, 1),
        ('svc@K@/items.py', 1, 0, 0),
        ('svc@K@/jobs/helper.py', 3, 2, 0),
        ('svc@K@/link_checker.py', 1, 0, 0),
        ('svc@K@/main.py', 1, 3, 0),
        ('svc@K@/models.py', 1, 0, 2),
        ('svc@K@/text/alt.py', 1, 0, 0),
        ('svc@K@/text/helper.py', 1, 0, 0),
        ('svc@K@/tools/run.py', 1, 0, 0),
        ('svc@K@/typed.py', 1, 0, 0),
    ]),
    "service_neighbourhood": ("path string, label string, imports string, imported_by string", [
        ('svc@K@/__init__.py', 'svc@K@/__init__', '', ''),
        ('svc@K@/api.py', 'svc@K@/api', 'svc@K@/db.py,svc@K@/models.py', 'svc@K@/main.py'),
        ('svc@K@/config.py', 'svc@K@/config', '', ''),
        ('svc@K@/db.py', 'svc@K@/db', '', 'svc@K@/api.py,svc@K@/jobs/helper.py,svc@K@/main.py'),
        ('svc@K@/envy.py', 'svc@K@/envy', '', ''),
        ('svc@K@/half.py', 'svc@K@/half', 'svc@K@/idle.py', 'svc@K@/main.py'),
        ('svc@K@/idle.py', 'svc@K@/idle', '', 'svc@K@/half.py'),
        ('svc@K@/items.py', 'svc@K@/items', '', ''),
        ('svc@K@/jobs/helper.py', 'jobs/helper', 'svc@K@/db.py,svc@K@/models.py', ''),
        ('svc@K@/link_checker.py', 'svc@K@/link_checker', '', ''),
        ('svc@K@/main.py', 'svc@K@/main', 'svc@K@/api.py,svc@K@/db.py,svc@K@/half.py', ''),
        ('svc@K@/models.py', 'svc@K@/models', '', 'svc@K@/api.py,svc@K@/jobs/helper.py'),
        ('svc@K@/text/alt.py', 'text/alt', '', ''),
        ('svc@K@/text/helper.py', 'text/helper', '', ''),
        ('svc@K@/tools/run.py', 'tools/run', '', ''),
        ('svc@K@/typed.py', 'svc@K@/typed', '', ''),
    ]),
    "service_file_page": ("what string, id string, details string", [
        ('edge', 'svc@K@/api.py', 'svc@K@/db.py'),
        ('edge', 'svc@K@/api.py', 'svc@K@/models.py'),
        ('edge', 'svc@K@/half.py', 'svc@K@/idle.py'),
        ('edge', 'svc@K@/jobs/helper.py', 'svc@K@/db.py'),
        ('edge', 'svc@K@/jobs/helper.py', 'svc@K@/models.py'),
        ('edge', 'svc@K@/main.py', 'svc@K@/api.py'),
        ('edge', 'svc@K@/main.py', 'svc@K@/db.py'),
        ('edge', 'svc@K@/main.py', 'svc@K@/half.py'),
        ('node', 'svc@K@/__init__.py', ''),
        ('node', 'svc@K@/api.py', 'imports svc@K@/db.py,imports svc@K@/models.py,imported by svc@K@/main.py'),
        ('node', 'svc@K@/config.py', ''),
        ('node', 'svc@K@/db.py', 'imported by svc@K@/api.py,imported by svc@K@/jobs/helper.py,imported by svc@K@/main.py'),
        ('node', 'svc@K@/envy.py', ''),
        ('node', 'svc@K@/half.py', 'imports svc@K@/idle.py,imported by svc@K@/main.py'),
        ('node', 'svc@K@/idle.py', 'imported by svc@K@/half.py'),
        ('node', 'svc@K@/items.py', ''),
        ('node', 'svc@K@/jobs/helper.py', 'imports svc@K@/db.py,imports svc@K@/models.py'),
        ('node', 'svc@K@/link_checker.py', ''),
        ('node', 'svc@K@/main.py', 'imports svc@K@/api.py,imports svc@K@/db.py,imports svc@K@/half.py'),
        ('node', 'svc@K@/models.py', 'imported by svc@K@/api.py,imported by svc@K@/jobs/helper.py'),
        ('node', 'svc@K@/text/alt.py', ''),
        ('node', 'svc@K@/text/helper.py', ''),
        ('node', 'svc@K@/tools/run.py', ''),
        ('node', 'svc@K@/typed.py', ''),
    ]),
    "service_fixes": ("path string, dead_imports bigint, unused_params bigint, future_imports bigint, content string", [
        ('svc@K@/__init__.py', 1, 0, 0, '"""Service @K@."""\n'),
        ('svc@K@/api.py', 1, 0, 0, 'from .models import Order_@K@, LIMIT_@K@\n@router.post("/orders")\n@audit\nasync def create_@K@(body):\n    try:\n        import json\n    except ImportError:\n        json = None\n    return save_@K@(body)\n@router.route("/both", methods=["GET", "POST"])\ndef both_@K@():\n    return LIMIT_@K@\n'),
        ('svc@K@/jobs/helper.py', 1, 1, 0, 'from svc@K@.db import save_@K@\ndef expire_@K@():\n    expires = datetime.now()\n    return expires\ndef retry_@K@(_x):\n    try:\n        risky_@K@()\n    except ValueError as e:\n        return save_@K@(e)\n    return default_@K@\n'),
        ('svc@K@/main.py', 2, 0, 0, '"""Entry of @K@."""\nfrom fastapi import FastAPI\nfrom . import api\nfrom .api import router as orders\napp = FastAPI()\napp.include_router(orders, prefix="/s@K@")\napp.include_router(orders)\napp.include_router(orders, prefix=PREFIX)\n@app.get("/ping")\ndef ping_@K@():\n    return api.both_@K@()\n'),
        ('svc@K@/typed.py', 1, 0, 0, 'WIDTH_@K@: int = 1\n'),
    ]),
    "service_context": ("path string, role string, refs string, issues string", [
        ('svc@K@/api.py', '2 API endpoints', 'create_@K@: NEVER USED outside this file; both_@K@: called from svc@K@/main.py:13; this file imports LIMIT_@K@ from svc@K@/models.py; this file imports Order_@K@ from svc@K@/models.py', '[low] line 1: DEAD_IMPORT: Order_@K@; [low] line 2: DEAD_IMPORT: store'),
        ('svc@K@/db.py', 'INCOMPLETE WIRING (connected but chain is broken)', 'save_@K@: imported by svc@K@/jobs/helper.py; save_@K@: called from svc@K@/api.py:10, svc@K@/envy.py:2, svc@K@/jobs/helper.py:10; find_@K@: NEVER USED outside this file; Repo_@K@: NEVER USED outside this file; risky_@K@: called from svc@K@/jobs/helper.py:8; get_db: NEVER USED outside this file; get_session: NEVER USED outside this file', ''),
        ('svc@K@/envy.py', 'UNREACHABLE (dead code)', 'many_@K@: NEVER USED outside this file', ''),
        ('svc@K@/jobs/helper.py', 'UNREACHABLE (dead code)', 'expire_@K@: NEVER USED outside this file; retry_@K@: NEVER USED outside this file; this file imports LIMIT_@K@ from svc@K@/models.py; this file imports save_@K@ from svc@K@/db.py', '[low] line 2: DEAD_IMPORT: LIMIT_@K@'),
        ('svc@K@/main.py', '1 API endpoints; registers 3 sub-routers; purpose: Entry of @K@.', 'app: NEVER USED outside this file; ping_@K@: NEVER USED outside this file', '[low] line 5: DEAD_IMPORT: svc@K@; [low] line 6: DEAD_IMPORT: svc@K@'),
        ('svc@K@/models.py', 'touches tables: orders_@K@, items_@K@ (via Item_@K@); purpose: Models of @K@.', 'Order_@K@: imported by svc@K@/__init__.py, svc@K@/api.py; Line_@K@: NEVER USED outside this file; LIMIT_@K@: imported by svc@K@/api.py, svc@K@/jobs/helper.py; stub_@K@: NEVER USED outside this file', ''),
        ('svc@K@/tools/run.py', 'utility module', 'dispatch_@K@: NEVER USED outside this file', ''),
    ]),
    "service_review": ("path string, line bigint, rule string, severity string, symbol string, source string", [
        ('svc@K@/db.py', 2, 'contract', 'high', 'is never ended', 'deep'),
        ('svc@K@/db.py', 2, 'contract', 'high', 'is never ended', 'triage'),
    ]),
    "service_across_context": ("part string, text string", [
        ('connectivity', 'INCOMPLETE: svc@K@/db.py'),
        ('connectivity', 'INCOMPLETE: svc@K@/half.py'),
        ('connectivity', 'INCOMPLETE: svc@K@/idle.py'),
        ('connectivity', 'UNREACHABLE: svc@K@/config.py'),
        ('connectivity', 'UNREACHABLE: svc@K@/envy.py'),
        ('connectivity', 'UNREACHABLE: svc@K@/items.py'),
        ('connectivity', 'UNREACHABLE: svc@K@/jobs/helper.py'),
        ('connectivity', 'UNREACHABLE: svc@K@/link_checker.py'),
        ('connectivity', 'UNREACHABLE: svc@K@/text/alt.py'),
        ('connectivity', 'UNREACHABLE: svc@K@/text/helper.py'),
        ('connectivity', 'UNREACHABLE: svc@K@/typed.py'),
        ('routes', 'GET /ping to svc@K@/main.py:ping_@K@'),
        ('routes', 'GET/POST /both to svc@K@/api.py:both_@K@'),
        ('routes', 'POST /orders to svc@K@/api.py:create_@K@'),
        ('routes', 'include_router prefix=/s@K@ to svc@K@/main.py'),
        ('routes', 'include_router prefix=<dynamic> to svc@K@/main.py include_router prefix is dynamic'),
        ('routes', 'include_router prefix=NO PREFIX to svc@K@/main.py include_router called without prefix'),
    ]),
    "service_review_across": ("path string, line bigint, rule string, severity string, symbol string, source string", [
        ('svc@K@/__init__.py', 1, 'shown', 'low', 'seen', 'across'),
        ('svc@K@/api.py', 1, 'shown', 'low', 'seen', 'across'),
        ('svc@K@/config.py', 1, 'shown', 'low', 'seen', 'across'),
        ('svc@K@/db.py', 1, 'shown', 'low', 'seen', 'across'),
        ('svc@K@/envy.py', 1, 'shown', 'low', 'seen', 'across'),
        ('svc@K@/half.py', 1, 'shown', 'low', 'seen', 'across'),
        ('svc@K@/idle.py', 1, 'shown', 'low', 'seen', 'across'),
        ('svc@K@/items.py', 1, 'shown', 'low', 'seen', 'across'),
        ('svc@K@/jobs/helper.py', 1, 'shown', 'low', 'seen', 'across'),
        ('svc@K@/link_checker.py', 1, 'shown', 'low', 'seen', 'across'),
        ('svc@K@/main.py', 1, 'shown', 'low', 'seen', 'across'),
        ('svc@K@/text/alt.py', 1, 'shown', 'low', 'seen', 'across'),
        ('svc@K@/text/helper.py', 1, 'shown', 'low', 'seen', 'across'),
        ('svc@K@/typed.py', 1, 'shown', 'low', 'seen', 'across'),
    ]),
    "service_json": ("table string, path string, what string", [
        ('findings', 'svc@K@/__init__.py', 'DEAD_IMPORT'),
        ('findings', 'svc@K@/api.py', 'DEAD_IMPORT'),
        ('findings', 'svc@K@/api.py', 'DEAD_IMPORT'),
        ('findings', 'svc@K@/jobs/helper.py', 'DEAD_IMPORT'),
        ('findings', 'svc@K@/main.py', 'DEAD_IMPORT'),
        ('findings', 'svc@K@/main.py', 'DEAD_IMPORT'),
        ('findings', 'svc@K@/typed.py', 'DEAD_IMPORT'),
        ('status', 'svc@K@/__init__.py', 'reachable'),
        ('status', 'svc@K@/api.py', 'reachable'),
        ('status', 'svc@K@/config.py', 'unreachable'),
        ('status', 'svc@K@/db.py', 'incomplete'),
        ('status', 'svc@K@/envy.py', 'unreachable'),
        ('status', 'svc@K@/half.py', 'incomplete'),
        ('status', 'svc@K@/idle.py', 'incomplete'),
        ('status', 'svc@K@/items.py', 'unreachable'),
        ('status', 'svc@K@/jobs/helper.py', 'unreachable'),
        ('status', 'svc@K@/link_checker.py', 'unreachable'),
        ('status', 'svc@K@/main.py', 'reachable'),
        ('status', 'svc@K@/models.py', 'reachable'),
        ('status', 'svc@K@/text/alt.py', 'unreachable'),
        ('status', 'svc@K@/text/helper.py', 'unreachable'),
        ('status', 'svc@K@/tools/run.py', 'reachable'),
        ('status', 'svc@K@/typed.py', 'unreachable'),
    ]),
    "questions_connectivity": ("path string, start_line bigint, end_line bigint, symbol string, signal string", [
        ('svc@K@/db.py', 1, 6, 'save_@K@', 'connectivity'),
        ('svc@K@/db.py', 10, 11, 'Repo_@K@.risky_@K@', 'connectivity'),
        ('svc@K@/db.py', 12, 13, 'get_db', 'connectivity'),
        ('svc@K@/db.py', 14, 15, 'get_session', 'connectivity'),
        ('svc@K@/db.py', 7, 8, 'find_@K@', 'connectivity'),
        ('svc@K@/half.py', 2, 3, 'wait_@K@', 'connectivity'),
        ('svc@K@/idle.py', 2, 3, 'rest_@K@', 'connectivity'),
    ]),
    "questions_soft_delete": ("path string, start_line bigint, end_line bigint, symbol string, signal string", [
        ('svc@K@/db.py', 7, 8, 'find_@K@', 'soft_delete'),
    ]),
    "questions_expiry": ("path string, start_line bigint, end_line bigint, symbol string, signal string", [
        ('svc@K@/jobs/helper.py', 3, 5, 'expire_@K@', 'expiry'),
    ]),
    "questions_temporal": ("path string, start_line bigint, end_line bigint, symbol string, signal string", [
        ('svc@K@/tools/run.py', 2, 5, 'dispatch_@K@', 'temporal: close'),
        ('svc@K@/tools/run.py', 2, 5, 'dispatch_@K@', 'temporal: commit'),
    ]),
    "questions_constraints": ("path string, start_line bigint, end_line bigint, symbol string, signal string", [
        ('svc@K@/text/alt.py', 1, 2, 'store_@K@: 150-char truncation', 'constraints'),
    ]),
    "questions_contracts": ("path string, start_line bigint, end_line bigint, symbol string, signal string", [
        ('svc@K@/db.py', 1, 6, 'save_@K@', 'contracts'),
    ]),
    "js_nodes_v1": ("id string, type string, name string, line_start bigint, parent_id string, docstring string", [
        ('class::svc@K@/web/app.js::App@K@', 'class', 'App@K@', 5, 'file::svc@K@/web/app.js', 'extends React'),
        ('class::svc@K@/web/side.js::Bare@K@', 'class', 'Bare@K@', 1, 'file::svc@K@/web/side.js', ''),
        ('file::svc@K@/web/app.js', 'file', 'app.js', 1, '', ''),
        ('file::svc@K@/web/side.js', 'file', 'side.js', 1, '', ''),
        ('fn::svc@K@/web/app.js::arrow@K@', 'function', 'arrow@K@', 16, 'file::svc@K@/web/app.js', ''),
        ('fn::svc@K@/web/app.js::inner@K@', 'function', 'inner@K@', 13, 'file::svc@K@/web/app.js', ''),
        ('fn::svc@K@/web/app.js::top@K@', 'function', 'top@K@', 12, 'file::svc@K@/web/app.js', ''),
        ('fn::svc@K@/web/side.js::top@K@', 'function', 'top@K@', 2, 'file::svc@K@/web/side.js', ''),
        ('fn::svc@K@/web/side.js::top@K@', 'function', 'top@K@', 3, 'file::svc@K@/web/side.js', ''),
        ('file::svc@K@/web/view.jsx', 'file', 'view.jsx', 1, '', ''),
        ('fn::svc@K@/web/view.jsx::List@K@', 'function', 'List@K@', 3, 'file::svc@K@/web/view.jsx', ''),
        ('fn::svc@K@/web/view.jsx::label', 'function', 'label', 4, 'file::svc@K@/web/view.jsx', ''),
        ('fn::svc@K@/web/view.jsx::after@K@', 'function', 'after@K@', 7, 'file::svc@K@/web/view.jsx', ''),
    ]),
    "js_edges_v1": ("source string, target string, type string, line bigint", [
        ('file::svc@K@/web/app.js', 'module::./api@K@', 'import', 2),
        ('file::svc@K@/web/app.js', 'module::fs', 'import', 4),
        ('file::svc@K@/web/app.js', 'module::side@K@.css', 'import', 3),
        ('file::svc@K@/web/view.jsx', 'module::./row@K@', 'import', 1),
    ]),
    "js_nodes_v2": ("id string, type string, name string, line_start bigint, parent_id string, docstring string", [
        ('class::svc@K@/web/app.js::App@K@', 'class', 'App@K@', 5, 'file::svc@K@/web/app.js', 'extends React.Component'),
        ('class::svc@K@/web/side.js::Bare@K@', 'class', 'Bare@K@', 1, 'file::svc@K@/web/side.js', ''),
        ('file::svc@K@/web/app.js', 'file', 'app.js', 1, '', ''),
        ('file::svc@K@/web/side.js', 'file', 'side.js', 1, '', ''),
        ('fn::svc@K@/web/app.js::arrow@K@', 'function', 'arrow@K@', 16, 'file::svc@K@/web/app.js', ''),
        ('fn::svc@K@/web/app.js::inner@K@', 'function', 'inner@K@', 13, 'file::svc@K@/web/app.js', ''),
        ('fn::svc@K@/web/app.js::made@K@', 'function', 'made@K@', 17, 'file::svc@K@/web/app.js', ''),
        ('fn::svc@K@/web/app.js::method:constructor@6', 'function', 'constructor', 6, 'file::svc@K@/web/app.js', ''),
        ('fn::svc@K@/web/app.js::method:load@K@@7', 'function', 'load@K@', 7, 'file::svc@K@/web/app.js', ''),
        ('fn::svc@K@/web/app.js::top@K@', 'function', 'top@K@', 12, 'file::svc@K@/web/app.js', ''),
        ('fn::svc@K@/web/side.js::method:run@1', 'function', 'run', 1, 'file::svc@K@/web/side.js', ''),
        ('fn::svc@K@/web/side.js::top@K@', 'function', 'top@K@', 2, 'file::svc@K@/web/side.js', ''),
        ('file::svc@K@/web/view.jsx', 'file', 'view.jsx', 1, '', ''),
        ('fn::svc@K@/web/view.jsx::List@K@', 'function', 'List@K@', 3, 'file::svc@K@/web/view.jsx', ''),
        ('fn::svc@K@/web/view.jsx::deep@K@', 'function', 'deep@K@', 5, 'file::svc@K@/web/view.jsx', ''),
        ('fn::svc@K@/web/view.jsx::after@K@', 'function', 'after@K@', 7, 'file::svc@K@/web/view.jsx', ''),
    ]),
    "js_edges_v2": ("source string, target string, type string, line bigint", [
        ('file::svc@K@/web/app.js', 'module::./api@K@', 'import', 2),
        ('file::svc@K@/web/app.js', 'module::./lazy@K@', 'import', 8),
        ('file::svc@K@/web/app.js', 'module::fs', 'import', 4),
        ('file::svc@K@/web/app.js', 'module::react', 'import', 1),
        ('file::svc@K@/web/app.js', 'module::side@K@.css', 'import', 3),
        ('file::svc@K@/web/view.jsx', 'module::./row@K@', 'import', 1),
    ]),
    "service_map": ("id string, target string", [
        ('class::svc@K@/web/app.js::App@K@', ''),
        ('class::svc@K@/web/side.js::Bare@K@', ''),
        ('class:svc@K@/db.py:Repo_@K@', ''),
        ('class:svc@K@/items.py:Item_@K@', ''),
        ('class:svc@K@/models.py:Line_@K@', ''),
        ('class:svc@K@/models.py:Order_@K@', ''),
        ('file::svc@K@/web/app.js', ''),
        ('file::svc@K@/web/app.js', 'module::./api@K@'),
        ('file::svc@K@/web/app.js', 'module::./lazy@K@'),
        ('file::svc@K@/web/app.js', 'module::fs'),
        ('file::svc@K@/web/app.js', 'module::react'),
        ('file::svc@K@/web/app.js', 'module::side@K@.css'),
        ('file::svc@K@/web/side.js', ''),
        ('file:svc@K@/__init__.py', ''),
        ('file:svc@K@/__init__.py', 'module:models.Order_@K@'),
        ('file:svc@K@/api.py', ''),
        ('file:svc@K@/api.py', 'file:svc@K@/db.py'),
        ('file:svc@K@/api.py', 'file:svc@K@/models.py'),
        ('file:svc@K@/api.py', 'file:svc@K@/models.py'),
        ('file:svc@K@/api.py', 'module:json'),
        ('file:svc@K@/config.py', ''),
        ('file:svc@K@/db.py', ''),
        ('file:svc@K@/envy.py', ''),
        ('file:svc@K@/half.py', ''),
        ('file:svc@K@/half.py', 'file:svc@K@/idle.py'),
        ('file:svc@K@/idle.py', ''),
        ('file:svc@K@/items.py', ''),
        ('file:svc@K@/jobs/helper.py', ''),
        ('file:svc@K@/jobs/helper.py', 'file:svc@K@/db.py'),
        ('file:svc@K@/jobs/helper.py', 'file:svc@K@/models.py'),
        ('file:svc@K@/link_checker.py', ''),
        ('file:svc@K@/main.py', ''),
        ('file:svc@K@/main.py', 'file:svc@K@/api.py'),
        ('file:svc@K@/main.py', 'file:svc@K@/api.py'),
        ('file:svc@K@/main.py', 'file:svc@K@/db.py'),
        ('file:svc@K@/main.py', 'file:svc@K@/half.py'),
        ('file:svc@K@/main.py', 'module:fastapi.FastAPI'),
        ('file:svc@K@/models.py', ''),
        ('file:svc@K@/text/alt.py', ''),
        ('file:svc@K@/text/helper.py', ''),
        ('file:svc@K@/tools/run.py', ''),
        ('file:svc@K@/tools/run.py', 'module:asyncio'),
        ('file:svc@K@/typed.py', ''),
        ('file:svc@K@/typed.py', 'module:__future__.annotations'),
        ('file::svc@K@/web/view.jsx', ''),
        ('file::svc@K@/web/view.jsx', 'module::./row@K@'),
    ]),
    "tree_scan": ("path string, n_lines bigint", [
        ('svc@K@/__init__.py', 2),
        ('svc@K@/api.py', 13),
        ('svc@K@/config.py', 1),
        ('svc@K@/db.py', 15),
        ('svc@K@/envy.py', 7),
        ('svc@K@/half.py', 3),
        ('svc@K@/idle.py', 3),
        ('svc@K@/items.py', 4),
        ('svc@K@/jobs/helper.py', 11),
        ('svc@K@/link_checker.py', 3),
        ('svc@K@/main.py', 13),
        ('svc@K@/models.py', 12),
        ('svc@K@/text/alt.py', 2),
        ('svc@K@/text/helper.py', 2),
        ('svc@K@/tools/run.py', 5),
        ('svc@K@/typed.py', 2),
    ]),
    "service_communities": ("id string, label string, n bigint", [
        ('file:svc@K@/api.py', 'file:svc@K@/api.py', 7),
        ('file:svc@K@/db.py', 'file:svc@K@/api.py', 7),
        ('file:svc@K@/half.py', 'file:svc@K@/api.py', 7),
        ('file:svc@K@/idle.py', 'file:svc@K@/api.py', 7),
        ('file:svc@K@/jobs/helper.py', 'file:svc@K@/api.py', 7),
        ('file:svc@K@/main.py', 'file:svc@K@/api.py', 7),
        ('file:svc@K@/models.py', 'file:svc@K@/api.py', 7),
    ]),
}
# fmt: on
