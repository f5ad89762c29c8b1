"""Word lists, patterns and thresholds that results depend on."""

# Abbreviations whose full stop ends no sentence.
GENERAL_ABBREVIATIONS = ["Dr.", "Mr.", "Mrs.", "Prof.", "Fig.", "Eq.", "et al.", "i.e.", "e.g.", "vs.", "No.", "Vol."]
LEGAL_ABBREVIATIONS = ["Dr.", "Mr.", "Mrs.", "Prof.", "Inc.", "Corp.", "Ltd.", "LLC", "No.", "v.", "vs.", "et al.", "i.e.", "e.g.", "U.S.", "Sec.", "Art.", "Para.", "Co.", "Ch."]

# Words that retrieval ignores.
STOP_WORDS = (
    "the a an of to and in on for with is was were be are that this it as at by from or but not no if do does did has have had will would should can may might he she they we i you"
).split()

# Signature starts, in the order in which they are tried.
SIGNATURES = [r"IN WITNESS WHEREOF", r"SIGNATURE PAGE FOLLOWS", r"\[Signature Page Follows\]", r"EXECUTED as of the date"]
# Patterns removed as redactions and stamps, in order.
STAMPS = [
    r"(?is)CERTAIN INFORMATION.*?REDACTED\.",
    r"\[\*+\]",
    r"(?i)\[REDACTED\]",
    r"(?i)OR\s+INDICATES\s+THAT\s+INFORMATION\s+HAS\s+BEEN\s+REDACTED\.?",
    r"(?i)\bEXECUTION\s+COPY\b",
    r"\bCONFIDENTIAL\b",
    r"\bDRAFT\b",
    r"\bPROPRIETARY\b",
]
# Patterns removed as footers and exhibit references, in order.
FOOTERS = [
    r"(?i)Source:\s+.*?\d{4}",
    r"(?i)\bExhibit\s+[\w.-]+\b",
    r"(?i)\bExh\.\s+[A-Z]-\d+\b",
    r"EXHIBIT\s+[A-Z]\s+[A-Z\s&/]+",
]
# Section headers, all multi-line.
SECTION_PATTERNS = [
    r"(?<!\w)ARTICLE\s+(?:[IVX]+|\d+)\.?\s*\n?\s*([A-Z][A-Z\s&;,]+)",
    r"(?<!\w)SECTION\s+\d+\.?\s*\n?\s*([A-Z][A-Z\s&;,]+)",
    r"^\d+\.(?:\d+)?\s+([A-Z][A-Z\s&;,]{3,})",
    r"(?<!\w)(WHEREAS|WITNESSETH|NOW[,\s]+THEREFORE)[,:]?",
    r"(?<!\w)(IN\s+WITNESS\s+WHEREOF)",
    r"^(RECITALS|DEFINITIONS|REPRESENTATIONS AND WARRANTIES|INDEMNIFICATION|MISCELLANEOUS|GOVERNING LAW|CONFIDENTIALITY|TERM AND TERMINATION|LIMITATION OF LIABILITY|DISPUTE RESOLUTION)$",
]

# Term patterns of span evaluation.
DEFINED_TERM = r"(?U)\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b"
MONEY = r"(?i)\$[0-9][\d,]*(?:\.\d+)?|\b\d[\d,]*\s*(?:dollars?|USD|cents?)\b"
TIME_SPAN = r"(?i)\b\d+\s*(?:days?|weeks?|months?|years?|hours?|minutes?)\b"
PARTY_WORDS = "licensor licensee company customer supplier seller buyer lessor lessee party parties counterparty contractor subcontractor employer employee agent principal guarantor".split()
SECTION_MARKER = r"(?i)^\s*(\([a-zA-Z0-9]+\)|\d+[\.\)]|Article\s+\w+|Section\s+\w+|§)"
BOUNDARY = ".;:\n"
NUMBER = r"\b\d[\d,]*(?:\.\d+)?\b"
DATE = r"\b\d{4}\b|\b\d{1,2}/\d{1,2}/\d{2,4}\b"
PARTY_NAME = r"\b(?:Licensor|Licensee|Buyer|Seller|Lessor|Lessee|Company|Customer|Supplier|Party|Parties)\b"

# Clause labels and their questions; other labels have none.
LABEL_QUESTIONS = {
    "payments": "What are the payment obligations?",
    "termination": "Under what conditions can this be terminated?",
    "termination for convenience": "Can this agreement be terminated for convenience?",
    "termination for cause": "Under what causes can this be terminated?",
    "term": "What is the term of this agreement?",
    "renewal": "How does this agreement renew?",
    "notices": "How must notices be given under this agreement?",
    "indemnification": "What indemnification obligations exist?",
    "indemnity": "What indemnity obligations exist?",
    "confidentiality": "What are the confidentiality requirements?",
    "non-disclosure": "What are the non-disclosure obligations?",
    "governing law": "What law governs this agreement?",
    "venue": "Where must disputes be filed?",
    "jurisdiction": "Which jurisdiction applies to disputes?",
    "warranties": "What warranties are provided?",
    "representations": "What representations are made?",
    "assignment": "Can this agreement be assigned?",
    "amendments": "How can this agreement be amended?",
    "waiver": "How can provisions of this agreement be waived?",
    "entire agreement": "What does the entire agreement clause state?",
    "severability": "What happens if a provision is unenforceable?",
    "force majeure": "What events qualify as force majeure?",
    "insurance": "What insurance is required?",
    "liability": "What are the liability limits?",
    "limitation of liability": "What limits apply to liability?",
    "arbitration": "How are disputes arbitrated?",
    "dispute resolution": "How are disputes resolved?",
    "counterparts": "How may this agreement be executed?",
    "headings": "What does the headings clause state?",
    "survival": "Which provisions survive termination?",
    "effectiveness": "When does this agreement become effective?",
    "expenses": "Which party bears expenses?",
    "fees": "What fees are payable under this agreement?",
    "taxes": "How are taxes allocated?",
    "audit": "What audit rights are provided?",
    "compliance with laws": "What compliance obligations exist?",
    "export control": "What export control obligations exist?",
    "anti-corruption": "What anti-corruption obligations exist?",
    "intellectual property": "What intellectual property rights are addressed?",
    "licenses": "What licenses are granted?",
    "grant of rights": "What rights are granted?",
    "publicity": "What publicity restrictions apply?",
    "non-compete": "What non-compete obligations apply?",
    "non-solicitation": "What non-solicitation obligations apply?",
    "subcontracting": "Can obligations be subcontracted?",
    "successors": "Who are bound as successors?",
    "relationship of parties": "What is the relationship between the parties?",
    "interpretation": "How is this agreement interpreted?",
    "definitions": "How are key terms defined?",
    "effective date": "When does this agreement take effect?",
}
