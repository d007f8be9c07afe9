"""Small relations that both engines read as SQL: rows that the given tables don't have."""

import json
import zlib

RECORDS = """(VALUES
 ('Main Campus (LHR)','Computer Science','A1','Morning','ECAT',82.5,1),('Main Campus (LHR)','Computer Science','A2','Evening','ECAT',78.25,1),
 ('New Campus (KSK)','Computer Science','A1','Morning','ECAT',74.125,2),('Faislabad Campus','Electrical Engineering','NM','Morning','ECAT',69.75,2),
 ('Gujaranwala','Mechanical Engineering','A1-M','Morning','Non-ECAT',66.0,3),('Narowal Campus (NWL)','Computer Engineering (NCEAC)','M','Morning','ECAT',61.5,3),
 ('Main Campus (LHR)','Artificial Intelligence','A1','Morning','ECAT',80.0,4),('Main Campus (LHR)','Civil Engineering','O','Morning','ECAT',58.0,4),
 ('Main Campus (LHR)','Computer Science','A1','Morning','ECAT',82.5,9)
) AS t(campus, program, category, session, admission_type, closing_merit, page)"""

QUESTIONS = """(VALUES
 (1,'What is the closing merit of Computer Science at Lahore?'),(2,'My aggregate is 79.5, can I get in CS at lhr category A2?'),
 (3,'I have 70.25 and want electrical engineering in Faisalabad'),(4,'Send me an email please'),(5,''),(6,'aggregate is 100 for ai'),
 (7,'show all programs at KSK'),(8,'which programs are below 70'),(9,'programs over 80 in Lahore'),(10,'I''m from Narowal with 61.4 in computer engineering'),
 (11,'hostel fee deadline'),(12,'merit for category P in civil engineering')
) AS t(qid, question)"""

LISTS = """(VALUES
 (0,'Merit List No. 1 2024','u0'),(1,'Second Merit List 2025','u1'),(2,'Minimum Merit - 3rd Merit List 2025','u2'),(3,'3rd Merit List, 2025','u3'),(4,'Fee schedule 2026','u4')
) AS t(pos, title, url)"""

CELLS = """(VALUES
 (1,0,'Campus'),(1,1,'Lahore'),(1,2,'Computer Science'),(1,3,'A1'),(1,4,'Morning'),(1,5,'ECAT'),(1,6,'81.5'),(1,7,'stray'),
 (1,8,'KSK'),(1,9,'Data Science'),(1,10,'nm'),(1,11,'Evening'),(1,12,'Non-ECAT'),(1,13,'70'),(1,14,'Lahore'),(1,15,'Short'),
 (2,0,'Somewhere'),(2,1,'Physics'),(2,2,'A2-M'),(2,3,'afternoon'),(2,4,'ecat'),(2,5,'100'),(2,6,'x'),(2,7,'y'),(2,8,'A1'),(2,9,'Morning'),(2,10,'ECAT'),(2,11,'101')
) AS t(page, pos, cell)"""

ITEMS = """(VALUES
 (1,'Code',10.0,10.0,10.0),(1,'Title',120.0,12.0,10.0),(1,'CS101',10.0,40.0,10.0),(1,'Intro',118.0,44.0,12.0),(1,'to',140.0,43.0,8.0),(1,'CS',160.0,41.0,10.0),
 (1,'CS102',11.0,70.0,10.0),(1,'Logic',121.0,71.0,10.0),(2,'alone',5.0,5.0,9.0)
) AS t(page, text, x, y, h)"""

LINKS = """(VALUES
 ('a','b',0),('a','c',1),('b','d',0),('c','d',0),('d','a',0),('d','e',1),('e','f',0),('x','y',0)
) AS t(src, dst, pos)"""

SECTIONS = """(VALUES
 (0,'All Programs','https://admission.example.edu/program'),(1,'Home','https://admission.example.edu/'),(2,'Apply Now','https://admission.example.edu/apply'),
 (3,'News','https://admission.example.edu/news'),(4,'news ','https://admission.example.edu/news/'),(5,'Mail','https://admission.example.edu/cdn-cgi/l/email-protection#1'),(6,'Gallery','https://admission.example.edu/g')
) AS t(pos, name, url)"""

ADDRESSES = """(VALUES
 (0,'HTTPS://Admission.Example.edu:443/a/b/?q=1#top','../c'),(1,'https://admission.example.edu','d.html'),(2,'[Fees](https://admission.example.edu/fees)','?p=2'),
 (3,'ftp://files.example.edu/x.pdf','//other.org/z'),(4,'/relative/path.PDF?x=1','#s'),(5,'https://www.admission.example.edu/UG-2026-1/doc.pdf?redirectFrom=ug','./e/../f'),
 (6,'https://admission.example.edu/MS-2026-2/','/g/h'),(7,'https://admission.example.edu/a/b/c','../../../i'),(8,'https://admission.example.edu/forgetchallan','https://x.org/y')
) AS t(pos, url, href)"""

TARGETS = """(VALUES
 (0,'https://admission.example.edu/program/cs','Computer Science'),(1,'https://admission.example.edu/account/login','Login'),(2,'https://admission.example.edu/news/3','Fee news'),
 (3,'https://other.org/program/','External'),(4,'https://admission.example.edu/faqs','FAQs'),(5,'https://admission.example.edu/docs/fee.pdf','Download'),(6,'https://admission.example.edu/docs/x.pdf','Schedule'),
 (7,'https://admission.example.edu/docs/y.docx','Form'),(8,'https://admission.example.edu/create-challan','Challan'),(9,'https://admission.example.edu/about','About us'),(10,'https://admission.example.edu/program/cs/','Computer Science again')
) AS t(pos, url, title)"""

LIST_PAGE = (
    '<h3>Fees</h3><a href="/fees.pdf">Fees</a><h4>First Merit List No. 1</h4><a href="/l1.pdf">first</a><p><a href="l1.pdf">again</a></p>'
    '<h4>Minimum Merit</h4><a href="/l2.pdf">Second Merit List</a><h4>PhD Merit List 3</h4><a href="/l3.pdf">no</a><h2>end</h2>'
)

#: A text for each branch of the page classifiers.
REVIEWS = """(VALUES
 (0,'https://admission.example.edu/x','',''),
 (1,'https://admission.example.edu/program/cs','CS','eligibility criteria and fee structure with deadline, merit list, scholarship and hostel for the degree program. apply online'),
 (2,'https://admission.example.edu/news/1','News','merit list and last date: fee schedule, deadline, scholarship, hostel, entry test, quota. Result and contact'),
 (3,'https://admission.example.edu/news/2','News','the hostel is open'),(4,'https://admission.example.edu/news/3','News','sports gala'),
 (5,'https://example.org/a','A','eligibility, hostel and scholarship'),(6,'https://example.org/b','B','hostel and quota'),
 (7,'https://example.org/c','C','congratulations and celebrating a proud moment'),(8,'https://example.org/d','D','nothing to see'),
 (9,'https://example.org/e','E','network restored after maintenance'),(10,'https://example.org/f','F','welcome to example, podcast series'),
 (11,'https://example.org/g','G','admission schedule: timeline of the semester'),(12,'https://admission.example.edu/faqs/','Frequently asked','contact us'),
 (13,'https://admission.example.edu/downloads/','Download','prospectus'),(14,'https://example.org/h','H','bachelor degree program'),
 (15,'https://admission.example.edu/foreign-students/','F','international student fees, accommodation, required documents'),(16,'https://admission.example.edu/UG-2026','U','orientation schedule'),
 (17,'https://example.org/news/4','N','ecat result and schedule')
) AS t(pos, url, title, text)"""

TYPED = """(VALUES
 (1,'show all programs at KSK'),(2,'list the programs'),(3,'programs below 75'),(4,'closing merit of cs over 80 morning'),(5,'what is the merit for artificial intelligence at main campus'),(6,'show civil engineering morning ecat category O'),
 (7,'show NM at Faislabad'),(8,'I have 79.5 for computer science evening'),(9,'closing for mechanical non-ecat'),(10,'find engineering at lhr'),(11,'merit for Intelligence'),(12,''),(13,'Show   all PROGRAMS in narowal under 70'),(14,'find electrical'),(15,'aggregate 101 and 61.5 for m')
) AS t(qid, question)"""

FILES = """(VALUES
 ('_sections.json'),('_selected_sections.json'),('_content_targets.json'),('_pages_reviewed.json'),('_knowledge_refined.json'),('_knowledge_books.json'),('_actions_registry.json'),('_knowledge_base.json'),('_pdf_downloads.json'),('_pdf_duplicates.json'),
 ('_pdf_knowledge_ab.json'),('_pdf_knowledge_'),('_pdf_knowledge'),('x.json'),('_Sections.json')
) AS t(name)"""


def _nested(levels: int) -> str:
    """A JSON document with an address on every level."""
    out = {"url": "deepest", "title": "t"}
    for k in range(levels):
        out = {"url": f"u{k}", "title": f"t{k}", "kids": [out, {"url": " "}]} if k % 2 else {"inner": [[out]], "x": {"url": f"u{k}", "title": f"t{k}"}, "n": k}
    return json.dumps(out)


def pdf(pages: list[list[str]], packed: bool) -> bytes:
    """A small PDF document with these lines on its pages."""
    parts = [b"%PDF-1.4\n", b"1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n", b"2 0 obj\n<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (4 + 2 * k) for k in range(len(pages))) + b"] /Count %d /Resources << /Font << /F1 3 0 R >> >> >>\nendobj\n" % len(pages), b"3 0 obj\n<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>\nendobj\n"]
    for k, lines in enumerate(pages):
        shown = b"\n".join(b"(" + x.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)").encode("cp1252") + b") Tj 0 -14 Td" for x in lines)
        data = b"BT\n/F1 12 Tf\n72 720 Td\n" + shown + b"\nET"
        data = zlib.compress(data) if packed else data
        parts.append(b"%d 0 obj\n<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>\nendobj\n%d 0 obj\n<< /Length %d%s >>\nstream\n" % (4 + 2 * k, 5 + 2 * k, 5 + 2 * k, len(data), b" /Filter /FlateDecode" * packed) + data + b"\nendstream\nendobj\n")
    return b"".join(parts) + b"trailer\n<< /Root 1 0 R >>\n%%EOF\n"


def pdf_table(rows: list[list[str]], packed: bool) -> bytes:
    """A PDF page with these cells in columns: every second row in a form, each word placed by the text matrix within a scaled and moved space, in a font of known widths."""
    shown = lambda x: b"(" + x.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)").encode("cp1252", "replace") + b")"

    def drawn(some: list[tuple[int, list[str]]]) -> bytes:
        cells = [b"1 0 0 1 %d %d Tm %s Tj" % (20 + 110 * j, 380 - 12 * k, shown(x)) for k, row in some for j, x in enumerate(row)]
        return b"q 2 0 0 2 10 0 cm BT /F1 5 Tf\n" + b"\n".join(cells) + b"\nET Q"

    numbered = list(enumerate(rows))
    page, form = drawn(numbered[::2]) + b"\nBI /W 1 /H 1 ID (\x00) EI\n/X1 Do", drawn(numbered[1::2])
    press, kind = (zlib.compress, b" /Filter /FlateDecode") if packed else (bytes, b"")
    page, form = press(page), press(form)
    return b"".join([
        b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [3 0 R] /Count 1 >>\nendobj\n",
        b"3 0 obj\n<< /Type /Page /Parent 2 0 R /MediaBox [0 0 800 800] /Contents 4 0 R /Resources << /Font << /F1 6 0 R >> /XObject << /X1 5 0 R >> >> >>\nendobj\n",
        b"4 0 obj\n<< /Length %d%s >>\nstream\n" % (len(page), kind), page, b"\nendstream\nendobj\n",
        b"5 0 obj\n<< /Type /XObject /Subtype /Form /Length %d%s >>\nstream\n" % (len(form), kind), form, b"\nendstream\nendobj\n",
        b"6 0 obj\n<< /Type /Font /Subtype /Type1 /FirstChar 32 /Widths [" + b" ".join([b"250"] + [b"500"] * 94) + b"] >>\nendobj\ntrailer\n<< /Root 1 0 R >>\n%%EOF\n",
    ])


#: Far more levels than are looked at in one go.
NESTED = _nested(12)

RAW_PAGES = """(VALUES
 (1,'{"title":" Fee Structure ","url":"https://x.example/fee#a","status":"core","role":" Core","book":"Fee Book","score":7,"categories":["Fees"," ECAT ",""],"type":"Program","reason":"r"}'),
 (2,'{"name":"N","title":"","page_url":"u2","refinement":{"decision_status":"skip","book_name":"a b","Score":2.5,"Categories":"fees, Merit ,,"},"page_type":"FAQ"}'),
 (3,'{"review":"no object","decision":{"title":"inner","status":"Review"},"categories":5}'),
 (4,'{"classification":{"role":"x"},"refinement":null,"title":null,"source_url":" u4 "}'),
 (5,'{}'),(6,'{"title":12,"score":"3","categories":[1,"B"]}')
) AS t(pos, doc)"""

MENUS = """(VALUES
 (1,'<ul class="nav-menu"><li><a href="/a">A</a></li></ul><ul class="nav-menu" id="quick"><a href="/q">Q</a><a href="#x">skip</a></ul>'),
 (2,'<ul class="nav-menu"><a href="/1">1</a></ul><ul class="big nav-menu top"><a href="/1">1</a><a href="/2">2</a><a href="/3">3</a><a href="/4">4</a><a href="/5">5</a><a href="/6">6</a><a href="/7">7</a></ul>'),
 (3,'<ul class="nav-menus"><a href="/1">1</a></ul><nav><a href="/2">2</a></nav>')
) AS t(pos, html)"""
