"""Named queries of the engine and the SQL that must give the same rows."""

from __future__ import annotations

from . import case_plans, crawl_plans, dom_plans, markup_plans, page_plans, payload_plans, security_plans

MODULES = (page_plans, security_plans, crawl_plans, dom_plans, payload_plans, case_plans, markup_plans)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
flagship = page_plans.flagship
