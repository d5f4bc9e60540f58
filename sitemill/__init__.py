"""sitemill: site-migration analytics as Spark DataFrame jobs.

``sitemill.plans.migration.Migration`` builds every relation of a migration
(tokens, sites, menus, URL map, redirects, link dispositions, crawl closure,
page identity, content, payloads) from a page archive; ``sitemill.plans.catalog``
registers one query per operator group with its DuckDB oracle.
"""
