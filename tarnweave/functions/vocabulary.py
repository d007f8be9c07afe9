"""Vocabularies and lookup tables of the operators.

Fixed values: word lists, aliases, patterns and codes that decide results. Order matters: first match wins.
"""

# ruff: noqa: E501

CATEGORY_KEYWORDS = {'eligibility': ['eligibility', 'eligible', 'qualification', 'qualifications', 'requirements', 'criteria', 'minimum marks', 'minimum percentage',
                 'equivalent', 'who can apply'],
 'fees': ['fee', 'fees', 'tuition', 'challan', 'payment', 'dues', 'charges', 'cost'],
 'deadlines': ['deadline', 'last date', 'last day', 'closing date', 'extended deadline', 'extend', 'extension', 'apply by', 'applications close',
               'registration closes', 'registration closed', 'due date'],
 'merit': ['merit list', 'merit lists', 'first merit', '1st merit', 'second merit', '2nd merit', 'third merit', '3rd merit', 'merit position',
           'merit number', 'selected candidates', 'selection list', 'selected candidate'],
 'scholarships': ['scholarship', 'scholarships', 'financial aid', 'fully funded', 'funded', 'stipend', 'hec scholarship'],
 'admission_process': ['admission process', 'apply', 'application process', 'how to apply', 'submission', 'documents', 'document submission',
                       'selected candidates', 'confirmation', 'enrollment', 'joining', 'admission procedure', 'admission instructions'],
 'documents': ['documents', 'required documents', 'original documents', 'document verification', 'attested', 'submission of documents'],
 'ecat': ['ecat', 'entry test', 'admit card', 'ecat result', 'ecat registration', 'ecat phase', 'ecat-01', 'ecat-02'],
 'schedule': ['schedule', 'date', 'dates', 'timeline', 'calendar', 'announcement date', 'releasing', 'release date', 'test date', 'orientation'],
 'hostel': ['hostel', 'hostels', 'accommodation', 'room allotment', 'hostel allotment'],
 'international': ['international', 'foreign student', 'foreign students', 'international student', 'international students', 'overseas'],
 'quota': ['quota', 'reserved seats', 'reserved seat', 'self finance', 'self-finance'],
 'programs': ['program', 'programs', 'bachelor', 'bachelors', 'undergraduate', 'master', 'masters', 'm.sc', 'm.phil', 'ms', 'ph.d', 'phd',
              'associate degree', 'degree program'],
 'contact': ['contact', 'admission office', 'admission cell', 'phone', 'telephone', 'email', 'query', 'queries', 'help desk']}

TEMPORAL_SIGNALS = {'deadline': ['last date', 'last day', 'deadline', 'apply by', 'extended deadline', 'deadline extended', 'deadline extension', 'applications close',
              'registration closes', 'registration closed'],
 'merit': ['merit list', '1st merit', '2nd merit', '3rd merit', 'first merit', 'second merit', 'third merit', 'selected candidates',
           'selection list'],
 'fee': ['fee schedule', 'fee structure', 'undergraduate fee', 'tuition fee', 'fee payment', 'fee deadline'],
 'schedule': ['admission schedule', 'admission process schedule', 'schedule', 'timeline', 'releasing on', 'release date'],
 'ecat': ['ecat result', 'ecat registration', 'ecat admit card', 'ecat phase', 'ecat 2026', 'entry test result'],
 'admission_process': ['admission process', 'selected candidates', 'document submission', 'how to complete documents', 'admission instructions',
                       'application process']}

PROMOTIONAL_SIGNALS = ['record response', 'welcome to {site}', 'where your future begins', 'meet our international student', 'student from', 'podcast series', 'podcast',
 'message from vc']

OPERATIONAL_SIGNALS = ['network services', 'network restored', 'portal restored', 'system restored', 'server', 'maintenance', 'technical issue']

PAGE_TYPE_PATTERNS = {'faq': ['/faqs(?:/|$)', '\\bfaq\\b', 'frequently asked'],
 'program': ['/program(?:/|$)', '\\bprogram\\b', '\\bprograms\\b', 'degree program', 'bachelor', 'master', 'ph\\.?d', 'associate degree'],
 'download': ['/downloads(?:/|$)', '\\bdownload\\b', '\\bprospectus\\b'],
 'foreign_students': ['/foreign-students(?:/|$)', 'foreign student', 'international student'],
 'news': ['/news(?:/|$)'],
 'admission': ['/UG-\\d', '/MS-\\d', '/PhD-\\d', '\\badmission\\b', 'apply now', 'application'],
 'home': ['^https?://{host}/?$']}

CONTENT_SIGNALS = {'eligibility': ['\\beligibility\\b', 'eligible candidates', 'eligibility criteria', 'minimum qualification', 'minimum marks'],
 'fee': ['\\bfee\\b', '\\bfees\\b', 'fee structure', 'fee schedule', 'tuition fee', 'admission fee'],
 'deadline': ['deadline', 'last date', 'last day', 'closing date', 'application deadline'],
 'merit': ['merit list', 'merit lists', 'merit position', 'selected candidates', 'waiting list'],
 'scholarship': ['scholarship', 'financial assistance', 'financial aid'],
 'admission_process': ['admission process', 'application process', 'how to apply', 'apply online', 'application procedure', 'step.*application'],
 'documents': ['required documents', 'documents required', 'documents', 'document checklist', 'original documents'],
 'ecat': ['\\becat\\b', 'entry test', 'entrance test'],
 'schedule': ['schedule', 'important dates', 'admission calendar', 'timeline'],
 'hostel': ['hostel', 'hostels', 'accommodation'],
 'quota': ['quota', 'reserved seats', 'reserved seat'],
 'international': ['international student', 'foreign student', 'foreign students'],
 'contact': ['contact us', 'admission office', 'admission cell', 'phone', 'email']}

ACTION_SIGNALS = {'apply': ['apply now', 'apply online', 'online application', 'submit application'],
 'download': ['download', 'prospectus', 'admission advertisement', 'fee schedule'],
 'check_merit': ['merit list', 'selected candidates', 'check merit'],
 'check_result': ['result', 'result announcement', 'ecat result'],
 'contact': ['contact', 'admission office', 'admission cell']}

KEEP_PAGE_TYPES = ['admission', 'download', 'faq', 'foreign_students', 'program']

LOW_VALUE_PATTERNS = ['welcome to {site}', 'where your future begins', 'record response', 'proud moment', 'celebrating', 'congratulations', 'success story', 'meet our',
 'message from vc']

KEEP_PAGE_PATTERNS = ['/program/', '/faqs(?:/|$)', '/foreign-students(?:/|$)', '/downloads(?:/|$)']

REVIEW_PAGE_PATTERNS = ['/news(?:/|$)']

ACTION_PAGE_PATTERNS = ['/account/', '/login(?:/|$)', '/forgetchallan(?:/|$)', '/create-challan(?:/|$)', '/modules/']

IMPORTANT_FILE_WORDS = ['prospectus', 'admission', 'guide', 'fee', 'merit', 'scholarship', 'schedule', 'advertisement', 'eligibility', 'program', 'undergraduate',
 'graduate', 'phd', 'ms']

ACTION_URL_PARTS = ['/account/login', '/account/forget', '/account/create', '/account/register', '/account/logout', '/application/', '/apply/', '/pg/account/',
 '/modules/']

CONTENT_URL_PARTS = ['/faqs', '/faq', '/program/', '/news', '/downloads', '/foreign-students', '/UG-', '/MS-', '/PhD-', '/PHD-']

DOCUMENT_EXTENSIONS = ['.csv', '.doc', '.docx', '.pdf', '.txt', '.xls', '.xlsx']

FILE_KINDS = {'.pdf': 'pdf',
 '.doc': 'document',
 '.docx': 'document',
 '.xls': 'spreadsheet',
 '.xlsx': 'spreadsheet',
 '.ppt': 'presentation',
 '.pptx': 'presentation',
 '.csv': 'csv',
 '.txt': 'text',
 '.zip': 'archive',
 '.rar': 'archive',
 '.jpg': 'image',
 '.jpeg': 'image',
 '.png': 'image',
 '.gif': 'image',
 '.webp': 'image'}

GENERIC_TITLES = ['click here', 'download', 'here', 'link']

ACTION_TYPES = ['account', 'admission_action', 'create_challan', 'forget_challan', 'login', 'module_action']

PROGRAM_LABELS = {'UG': 'Undergraduate', 'MS': "Master's", 'PHD': 'PhD', 'PG': 'Postgraduate'}

STATUSES = ['CORE', 'REVIEW', 'SKIP', 'SUPPORTING', 'TEMPORAL']

USABLE_STATUSES = ['CORE', 'SUPPORTING', 'TEMPORAL']

ROLES = ['core', 'operational', 'promotional', 'supporting', 'temporal']

BOOKS = ['admission_process', 'deadlines', 'ecat', 'eligibility', 'faq', 'fees', 'international_admissions', 'programs', 'scholarships', 'temporal_updates']

CHUNK_FIELDS = ['canonical_url', 'canonical_title', 'sha256', 'all_urls', 'pdf_file', 'page', 'chunk_index', 'text', 'source', 'quality_flag']

TABLE_CAMPUS_ALIASES = {'lhr': 'Main Campus (LHR)',
 'lahore': 'Main Campus (LHR)',
 'main': 'Main Campus (LHR)',
 'main campus': 'Main Campus (LHR)',
 'main campus lhr': 'Main Campus (LHR)',
 'ksk': 'New Campus (KSK)',
 'new': 'New Campus (KSK)',
 'new campus': 'New Campus (KSK)',
 'new campus ksk': 'New Campus (KSK)',
 'fsd': 'Faislabad Campus',
 'faislabad': 'Faislabad Campus',
 'faisalabad': 'Faislabad Campus',
 'faislabad campus': 'Faislabad Campus',
 'faisalabad campus': 'Faislabad Campus',
 'grw': 'Gujaranwala',
 'gujranwala': 'Gujaranwala',
 'gujaranwala': 'Gujaranwala',
 'gujranwala campus': 'Gujaranwala',
 'nwl': 'Narowal Campus (NWL)',
 'narowal': 'Narowal Campus (NWL)',
 'narowal campus': 'Narowal Campus (NWL)'}

TABLE_PROGRAM_ALIASES = {'cs': 'Computer Science',
 'computer science': 'Computer Science',
 'ai': 'Artificial Intelligence',
 'artificial intelligence': 'Artificial Intelligence',
 'cyber': 'Cybersecurity',
 'cyber security': 'Cybersecurity',
 'cybersecurity': 'Cybersecurity',
 'ds': 'Data Science',
 'data science': 'Data Science',
 'ee': 'Electrical Engineering',
 'electrical': 'Electrical Engineering',
 'electrical engineering': 'Electrical Engineering',
 'ce': 'Computer Engineering (NCEAC)',
 'computer engineering': 'Computer Engineering (NCEAC)',
 'me': 'Mechanical Engineering',
 'mechanical': 'Mechanical Engineering',
 'mechanical engineering': 'Mechanical Engineering',
 'civil': 'Civil Engineering',
 'civil engineering': 'Civil Engineering'}

TABLE_CATEGORY_ALIASES = {'a1': 'A1',
 'a1m': 'A1-M',
 'a1-m': 'A1-M',
 'a2': 'A2',
 'a2m': 'A2-M',
 'a2-m': 'A2-M',
 'ap1': 'AP1',
 'ap1m': 'AP1-M',
 'ap1-m': 'AP1-M',
 'ap2': 'AP2',
 'ap2m': 'AP2-M',
 'ap2-m': 'AP2-M',
 'm': 'M',
 'nm': 'NM',
 'l': 'L',
 'n': 'N',
 'o': 'O',
 'p': 'P',
 'r': 'R',
 's': 'S',
 't': 'T'}

ORDINAL_WORDS = {'first': 1,
 'second': 2,
 'third': 3,
 'fourth': 4,
 'fifth': 5,
 'sixth': 6,
 'seventh': 7,
 'eighth': 8,
 'ninth': 9,
 'tenth': 10,
 'eleventh': 11,
 'twelfth': 12}

POSTGRADUATE_WORDS = ['postgraduate', 'm.sc', 'ms ', 'ph.d', 'phd']

SESSIONS = {'morning': 'Morning', 'evening': 'Evening', 'afternoon': 'Afternoon'}

ADMISSION_TYPES = {'ecat': 'ECAT', 'non-ecat': 'Non-ECAT'}

HEADER_CELLS = ['campus', 'category', 'closing merit', 'discipline', 'session', 'type']

QUESTION_CAMPUS_ALIASES = {'lahore': 'Main Campus (LHR)',
 'lhr': 'Main Campus (LHR)',
 'lahore campus': 'Main Campus (LHR)',
 'main campus': 'Main Campus (LHR)',
 'main campus lhr': 'Main Campus (LHR)',
 'ksk': 'New Campus (KSK)',
 'new campus': 'New Campus (KSK)',
 'new campus ksk': 'New Campus (KSK)',
 'faisalabad': 'Faislabad Campus',
 'faislabad': 'Faislabad Campus',
 'faisalabad campus': 'Faislabad Campus',
 'fsd': 'Faislabad Campus',
 'gujranwala': 'Gujaranwala',
 'gujaranwala': 'Gujaranwala',
 'gujranwala campus': 'Gujaranwala',
 'grw': 'Gujaranwala',
 'narowal': 'Narowal Campus (NWL)',
 'nwl': 'Narowal Campus (NWL)',
 'narowal campus': 'Narowal Campus (NWL)'}

QUESTION_PROGRAM_ALIASES = {'computer science': 'Computer Science',
 'cs': 'Computer Science',
 'computer engineering': 'Computer Engineering',
 'ce': 'Computer Engineering',
 'software engineering': 'Software Engineering',
 'se': 'Software Engineering',
 'electrical engineering': 'Electrical Engineering',
 'ee': 'Electrical Engineering',
 'mechanical engineering': 'Mechanical Engineering',
 'me': 'Mechanical Engineering',
 'civil engineering': 'Civil Engineering',
 'civil': 'Civil Engineering',
 'chemical engineering': 'Chemical Engineering',
 'architecture': 'Architecture',
 'architectural engineering': 'Architectural Engineering',
 'environmental engineering': 'Environmental Engineering',
 'industrial engineering': 'Industrial & Manufacturing Engineering',
 'transportation engineering': 'Transportation Engineering',
 'petroleum engineering': 'Petroleum & Gas Engineering',
 'mining engineering': 'Mining Engineering',
 'mechatronics': 'Mechatronics & Control Engineering',
 'biomedical engineering': 'Biomedical Engineering',
 'food engineering': 'Food Science & Technology',
 'metallurgical engineering': 'Metallurgical & Materials Engineering',
 'artificial intelligence': 'Artificial Intelligence',
 'ai': 'Artificial Intelligence',
 'cybersecurity': 'Cybersecurity',
 'cyber security': 'Cybersecurity',
 'cyber': 'Cybersecurity',
 'data science': 'Data Science',
 'ds': 'Data Science',
 'business administration': 'Bachelor of Business Administration',
 'bba': 'Bachelor of Business Administration',
 'business information technology': 'Bachelor of Business Information Technology',
 'bbit': 'Bachelor of Business Information Technology',
 'business analytics': 'Business Analytics',
 'business data analytics': 'Business Data Analytics'}

MERIT_KEYWORDS = ['merit', 'aggregate', 'selected', 'selection', 'closing merit', 'cutoff', 'cut off', 'minimum merit', 'minimum aggregate', 'last merit',
 'merit list', 'meritlist', 'closing aggregate', 'above merit', 'below merit', 'my aggregate', 'my merit', 'can i get admission', 'can i get in',
 'will i get admission', 'am i selected', 'got selected']

#: Under which names a page's fields may stand, in order (fixed values).
PAGE_FIELDS = {
    "title": ["title", "name", "page_title"],
    "url": ["url", "page_url", "source_url"],
    "status": ["status", "Status", "decision_status"],
    "role": ["role", "Role", "source_role"],
    "book": ["book", "Book", "book_target", "book_name"],
    "score": ["score", "Score"],
    "categories": ["categories", "Categories"],
    "type": ["type", "Type", "page_type"],
    "reason": ["reason", "Reason"],
}

#: Objects within a page that may hold its fields, in order (fixed values).
NESTED_FIELDS = ["refinement", "knowledge_refinement", "knowledge_refined", "classification", "decision", "review"]

#: Patterns of a typed question's filter words (fixed values).
FILTER_WORDS = r"\b(?:what|what is|show|find|merit|closing|minimum|for|at|the|campus|morning|evening|afternoon|ecat|non[- ]?ecat)\b"
CATEGORY_WORDS = r"\b(?:a1m|a2m|ap1m|ap2m|a1|a2|ap1|ap2|nm|m)\b"

#: What is said where a question about closing marks has no answer (fixed values).
MERIT_MESSAGES = {
    "merit_unavailable": "The latest {site} merit list could not be retrieved right now.",
    "merit_empty": "The latest {site} merit PDF was downloaded, but no merit records could be extracted.",
    "merit_not_found": "No current merit record was found for the requested program, campus, or category.",
    "merit_invalid_records": "Matching merit records were found, but their closing merit could not be read.",
}
