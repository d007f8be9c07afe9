"""Relations that the given tables don't hold as such, derived from them by SQL that both engines read: closing marks from orders, questions from conversations, links, menus and addresses from pages.

Each is a subquery over whole tables. The forms that a branch needs (an address without a scheme, a title that names a list) come from the small relations of `fixtures`, one for each remainder of a row's id, and are filled with the row's own values.
"""

from tarnweave.plans import fixtures as X

#: The first link of a page, which every page has.
HREF, NAME = """regexp_extract(p.html, '<a href="([^"]*)">([^<]*)</a>', 1)""", """regexp_extract(p.html, '<a href="([^"]*)">([^<]*)</a>', 2)"""

#: Closing marks: what the orders of a campus, program, category and status come to, in quarters. The page is a group's first order, which no other group has.
RECORDS = """(SELECT campus, program, category, session, admission_type, CAST(55 + sum(marks) % 160 / 4.0 AS DOUBLE) AS closing_merit, min(o_orderkey) AS page
 FROM (SELECT l_orderkey, sum(CAST(l_quantity AS BIGINT)) AS marks FROM lineitem GROUP BY l_orderkey) AS l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey
 JOIN (VALUES (0,'Main Campus (LHR)'),(1,'New Campus (KSK)'),(2,'Faislabad Campus'),(3,'Gujaranwala'),(4,'Narowal Campus (NWL)')) AS a(k1, campus) ON k1 = c_nationkey % 5
 JOIN (VALUES (0,'Computer Science'),(1,'Electrical Engineering'),(2,'Mechanical Engineering'),(3,'Computer Engineering (NCEAC)'),(4,'Artificial Intelligence'),(5,'Civil Engineering'),(6,'Data Science')) AS b(k2, program) ON k2 = o_custkey % 7
 JOIN (VALUES (0,'A1','Morning','ECAT'),(1,'A2','Evening','ECAT'),(2,'NM','Morning','Non-ECAT'),(3,'O','Morning','ECAT')) AS c(k3, category, session, admission_type) ON k3 = o_orderkey % 4
 GROUP BY campus, program, category, session, admission_type, o_orderstatus) AS r"""


def _asked(forms: str, n: int) -> str:
    return f"""(SELECT c.conv_id * 1000 + c.turn AS qid, replace(t.question, '79.5', 50 + length(c.text) % 50 || '.5') || CASE WHEN t.question <> '' AND (c.conv_id + c.turn) % 3 = 0 THEN ' ' || c.text ELSE '' END AS question
 FROM (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations) AS c JOIN {forms} ON t.qid = 1 + (c.conv_id * 3 + c.turn) % {n}) AS q"""


#: A question for each turn of a conversation; a third also hold what was said.
QUESTIONS, TYPED = _asked(X.QUESTIONS, 12), _asked(X.TYPED, 15)

LISTS = f"""(SELECT p.page_id AS pos, replace(replace(t.title, 'No. 1', 'No. ' || (1 + p.page_id % 9)), '2025', '' || (2010 + p.page_id % 17)) || ' ' || {NAME} AS title, p.url FROM pages AS p JOIN {X.LISTS} ON t.pos = p.page_id % 5) AS l"""

#: Whole pages with a list section each.
LIST_PAGES = f"""(SELECT p.page_id, p.html || replace('{X.LIST_PAGE}', '/l', '/' || p.page_id || '/l') AS html FROM pages AS p) AS l"""

#: Cells of a customer's orders: six each, and a stray one after every second.
CELLS = """(SELECT o_custkey AS page, o_orderkey * 10 + nth AS pos, CASE nth WHEN 0 THEN CASE o_orderkey % 5 WHEN 0 THEN 'Lahore' WHEN 1 THEN 'KSK' WHEN 2 THEN 'Somewhere' WHEN 3 THEN 'Campus' ELSE 'Narowal' END
 WHEN 1 THEN CASE o_orderkey % 3 WHEN 0 THEN 'Physics' WHEN 1 THEN 'Data Science' ELSE 'Computer Science' END WHEN 2 THEN CASE o_orderkey % 7 WHEN 0 THEN 'A1' WHEN 1 THEN 'nm' WHEN 2 THEN 'A2-M' WHEN 3 THEN 'ap1' WHEN 4 THEN 'none' ELSE 'M' END
 WHEN 3 THEN CASE o_orderstatus WHEN 'F' THEN 'Morning' WHEN 'O' THEN 'evening' ELSE 'afternoon' END WHEN 4 THEN CASE o_orderkey % 11 WHEN 0 THEN 'ecat' WHEN 1 THEN 'other' WHEN 2 THEN 'Non-ECAT' ELSE 'ECAT' END
 WHEN 5 THEN CAST(floor(o_totalprice / 1000) AS BIGINT) % 120 || '.25' ELSE 'stray' END AS cell FROM orders JOIN (VALUES (0),(1),(2),(3),(4),(5),(6)) AS k(nth) ON nth < 6 + o_orderkey % 2) AS c"""

#: Words of a customer's orders on a page: one to three to an order.
ITEMS = """(SELECT o_custkey AS page, CASE nth WHEN 0 THEN 'CS' || o_orderkey WHEN 1 THEN o_orderpriority ELSE o_orderstatus END AS text, CAST(10 + 110 * nth + o_orderkey % 5 AS DOUBLE) AS x, CAST(o_orderkey % 40 * 13 + nth * 2 AS DOUBLE) AS y,
 CAST(9 + o_orderkey % 4 AS DOUBLE) AS h FROM orders JOIN (VALUES (0),(1),(2)) AS k(nth) ON nth < 1 + o_orderkey % 3) AS i"""

SECTIONS = f"""(SELECT p.page_id AS pos, CASE WHEN t.pos = 6 THEN {NAME} ELSE t.name END AS name, CASE WHEN t.pos IN (1, 5) THEN t.url ELSE t.url || {HREF} END AS url FROM pages AS p JOIN {X.SECTIONS} ON t.pos = p.page_id % 7) AS s"""

ADDRESSES = f"""(SELECT page_id AS pos, CASE page_id % 9 WHEN 0 THEN replace(replace(url, 'http', 'HTTP'), 'example', 'Example') WHEN 1 THEN 'https://admission.example.edu' WHEN 2 THEN '[Fees](' || url || ')' WHEN 3 THEN 'ftp://files.example.edu/' || page_id || '.pdf'
 WHEN 4 THEN '/relative/' || page_id || '.PDF?x=1' WHEN 5 THEN 'https://www.admission.example.edu/UG-2026-1/' || page_id || '.pdf?redirectFrom=ug' WHEN 6 THEN 'https://admission.example.edu/MS-2026-2/' || page_id || '/' WHEN 7 THEN ' ' || url ELSE url || '&forgetchallan' END AS url,
 CASE page_id % 11 WHEN 0 THEN '../c' WHEN 1 THEN 'd.html' WHEN 2 THEN '?p=2' WHEN 3 THEN '//other.org/z' WHEN 4 THEN '#s' WHEN 5 THEN './e/../f' WHEN 6 THEN '/g/h' WHEN 7 THEN '../../../i' WHEN 8 THEN 'https://x.org/y' ELSE {HREF} END AS href FROM pages AS p) AS a"""

#: A page's address, or its first link with the ending of a form.
TARGETS = f"""(SELECT p.page_id AS pos, CASE WHEN p.page_id % 4 = 0 THEN p.url ELSE replace(t.url, '.edu', '.edu' || {HREF}) END AS url, t.title || ' ' || {NAME} AS title FROM pages AS p JOIN {X.TARGETS} ON t.pos = p.page_id % 11) AS g"""

REVIEWS = f"""(SELECT d.doc_id AS pos, t.url, t.title, CASE WHEN t.text = '' THEN '' ELSE t.text || ' ' || coalesce(d.text, '') END AS text FROM documents AS d JOIN {X.REVIEWS} ON t.pos = d.doc_id % 18) AS r"""

FILES = """(SELECT d.doc_id, CASE d.doc_id % 14 WHEN 0 THEN '_sections.json' WHEN 1 THEN '_selected_sections.json' WHEN 2 THEN '_content_targets.json' WHEN 3 THEN '_pages_reviewed.json' WHEN 4 THEN '_knowledge_refined.json' WHEN 5 THEN '_knowledge_books.json' WHEN 6 THEN '_actions_registry.json'
 WHEN 7 THEN '_knowledge_base.json' WHEN 8 THEN '_pdf_downloads.json' WHEN 9 THEN '_pdf_duplicates.json' WHEN 10 THEN '_pdf_knowledge' WHEN 11 THEN '_Sections.json' WHEN 12 THEN d.source || '.json' ELSE '_pdf_knowledge_' || d.source || '_' || d.doc_id || '.json' END AS name FROM documents AS d) AS f"""

#: A document of many levels for each page, with its address at the bottom.
NESTED = f"""(SELECT p.page_id, replace(replace('{X.NESTED}', 'deepest', p.url), '"t"', '"page ' || p.page_id || '"') AS doc FROM pages AS p) AS n"""

RAW_PAGES = f"""(SELECT p.page_id AS pos, replace(replace(replace(t.doc, 'https://x.example/fee#a', p.url), '"u2"', '"' || p.url || '"'), ' Fee Structure ', ' Page ' || p.page_id || ' ') AS doc FROM pages AS p JOIN {X.RAW_PAGES} ON t.pos = 1 + p.page_id % 6) AS w"""

MENUS = f"""(SELECT p.page_id AS pos, p.html || replace(t.html, 'href="/', 'href="/' || p.page_id || '/') AS html FROM pages AS p JOIN {X.MENUS} ON t.pos = 1 + p.page_id % 3) AS m"""
