"""Fixed values.

Every constant in this module has to equal the published behaviour for results to
match: replacement tables, patterns, prompt texts, catalogs, status codes.  They are
stated in their natural order because the order is part of the semantics.
"""

from __future__ import annotations

from folioforge.functions.charclass import D, NS, S, W, WORD, WS

# --- fixed values: mis-decoded text and its repair, applied top to bottom ---------
ENCODING_FIXES = [
    ("â€™", "'"),
    ("â€œ", '"'),
    ("â€", '"'),
    ("Ã©", "é"),
    ("Ã¨", "è"),
    ("Ã«", "ë"),
    ("Ã¶", "ö"),
    ("Ã¼", "ü"),
    ("Ã¢", "â"),
    ("â€“", "–"),
    ("â€”", "—"),
    ("Ã˜", "Ø"),
    ("Ã¥", "å"),
    ("Ã¦", "æ"),
    ("Ã§", "ç"),
    ("Ã±", "ñ"),
]

# --- fixed values: mis-decoded math symbols, applied top to bottom ----------------
MATH_SYMBOL_FIXES = [
    ("âˆ†", "∆"),
    ("âˆ‘", "∑"),
    ("âˆ", "√"),
    ("âˆž", "∞"),
    ("âˆ«", "∫"),
    ("âˆ‚", "∂"),
    ("âˆ‡", "∇"),
    ("âˆˆ", "∈"),
    ("âˆ‰", "∉"),
    ("âŠ‚", "⊂"),
    ("âŠƒ", "⊃"),
    ("âˆ©", "∩"),
    ("âˆª", "∪"),
    ("âˆ§", "∧"),
    ("âˆ¨", "∨"),
    ("âˆ€", "∀"),
    ("âˆƒ", "∃"),
    ("Â±", "±"),
    ("Ã—", "×"),
    ("Â·", "·"),
    ("â‰¤", "≤"),
    ("â‰¥", "≥"),
    ("â‰ ", "≠"),
]

# --- fixed values: abbreviation expansion, plain substrings, top to bottom --------
ABBREVIATIONS = [
    ("e.g", "e.g."),
    ("i.e", "i.e."),
    ("et al", "et al."),
    ("vs", "vs."),
    ("Fig", "Figure"),
    ("Eq", "Equation"),
    ("Sect", "Section"),
    ("Chapt", "Chapter"),
    ("App", "Appendix"),
]

# --- fixed values: LaTeX escapes and what replaces them ---------------------------
LATEX_ESCAPES = [
    ("\\(", " ("),
    ("\\)", ") "),
    ("\\[", "["),
    ("\\]", "] "),
]

# --- fixed values: math symbols ---------------------------------------------------
MATH_SYMBOLS = "∑∫∏√∂∇∞∈∉⊂⊃∩∪∧∨∀∃¬"
# The range test in front spares ordinary characters one test per symbol.
_SYMBOL = rf"(?=[¬\x{{2200}}-\x{{22FF}}])[{MATH_SYMBOLS}]"

# --- fixed values: math block patterns (type, pattern) ----------------------------
_INLINE_DOLLAR = r"\$[^\$]+\$"
_DISPLAY = r"(?s)\\\[.*?\\\]"
_INLINE_PAREN = r"(?s)\\\(.*?\\\)"

PROTECTED_BLOCK_PATTERNS = [
    ("inline_math", _INLINE_DOLLAR),
    ("display_math", _DISPLAY),
    ("inline_math", _INLINE_PAREN),
    ("env_math", r"(?s)\\begin\{.*?\}.*?\\end\{.*?\}"),
]

EQUATION_PATTERNS = [
    ("inline", _INLINE_DOLLAR),
    ("display", _DISPLAY),
    ("inline", _INLINE_PAREN),
    ("display", r"(?s)\\begin\{equation\}.*?\\end\{equation\}"),
    ("display", r"(?s)\\begin\{align\}.*?\\end\{align\}"),
    ("display", r"(?s)\\begin\{eqnarray\}.*?\\end\{eqnarray\}"),
    ("simple", rf"[=≠≤≥±×÷]{S}*[0-9a-zA-Z()\^_{{}}]+"),
    ("symbol", _SYMBOL),
]
EQUATION_CONTEXT_CHARS = 100

COUNTED_EQUATION_PATTERNS = [_INLINE_DOLLAR, _DISPLAY, _INLINE_PAREN]
MATH_CHARACTER = rf"(?![a-zA-Z ])(?:[\$\\=≠≤≥±×÷\^_{{}}]|{_SYMBOL})"

# --- fixed values: lines that open a section, and the word stride of page marks ---
SECTION_LINE = (
    rf"^(?:Chapter{S}+{D}"
    rf"|Section{S}+{D}"
    rf"|{D}+\.{D}+{S}+[A-Z][a-z]"
    rf"|{D}+\.{D}+\.{D}+{S}+[A-Z][a-z]"
    r"|(?:Abstract|Introduction|Conclusion|Appendix|References)"
    rf"|[A-Z][A-Z{WS}]+\z)"
)
WORDS_PER_MARK = 500

# --- fixed values: heading lines on top of a page (matched on stripped lines) -----
PAGE_NUMBER_LINE = rf"^(?:{D}{{1,4}}|[ivxlcdmIVXLCDM]{{1,7}})\z"
CHAPTER_LINE = rf"^(?:CHAPTER|Chapter){S}+{D}+(?!{W})"
SECTION_HEADING_LINE = rf"^{D}+(?:\.{D}+)*\.?{S}+[A-Z][^\n]{{0,120}}\z"
HEADING_SCAN_LINES = 12

# --- fixed values: splitting ------------------------------------------------------
PARAGRAPH_BREAK = rf"\n{S}*\n"
SENTENCE_BREAK = rf"(?<=[.!?]){S}+(?=[A-Z0-9\"'(])"
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200
MIN_CHUNK_SIZE = 100

# --- fixed values: extraction diagnostics -----------------------------------------
# Key is the pattern as published (the report prints it); value is its Java spelling.
MOJIBAKE_PATTERNS = [
    (r"Ō[\wąćęłńóśźż]+", rf"Ō[{WORD}ąćęłńóśźż]+"),
    (r"Ž[\w]+", rf"Ž{W}+"),
    (r"╬[\w]*", rf"╬{W}*"),
    (r"â€[\w]*", rf"â€{W}*"),
    (r"Ã[\w]", rf"Ã{W}"),
    (r"Â[\w]", rf"Â{W}"),
    (r"√[\w]", rf"√{W}"),
]
HEADING_START = rf"^{S}*{D}+(?:\.{D}+)*\.?{S}+[A-Z]"
CHAPTER_START = rf"^{S}*(?:CHAPTER|Chapter){S}+{D}"
ALLCAPS_HEADING = rf"^{S}*[A-Z][A-Z{WS}\-]{{5,}}\z"
LEADING_PAGE_NUMBER = rf"^{S}*(?:{NS}+{S}+){{0,8}}?{D}{{2,4}}{S}+{NS}"
PAGE_NUMBER_RESIDUE = rf"(?:^|\n){S}*{D}{{1,4}}{S}*(?=\n|\z)"
MISSING_SPACE = rf"[a-z][A-Z]|[a-z]{D}{{2,}}"
REPEATED_LETTER = r"([a-zA-Z])\1{2,}"
TRAILING_WHITESPACE = r"[ \t]+\n"
UNICODE_MATH = (
    r"[\x{2200}-\x{22FF}\x{2A00}-\x{2AFF}\x{27C0}-\x{27EF}\x{2980}-\x{29FF}"
    "¬=±×÷]"  # the other symbols and relations lie in the first range
)
HIGH_MATH_DENSITY = 0.03
CAPTION_PATTERNS = [
    ("figure", rf"(?iu)(?<!{W})(?:Figure|Fig\.){S}*{D}+"),
    ("table", rf"(?iu)(?<!{W})Table{S}*{D}+"),
    ("algorithm", rf"(?iu)(?<!{W})(?:Algorithm|Alg\.){S}*{D}+"),
    ("equation", rf"(?iu)(?<!{W})(?:Equation|Eq\.){S}*{D}+"),
]
EMPTY_PAGE_CHARS = 100
WORST_LIMIT = 20
SAMPLE_LIMIT = 5

# Characters counted as digits that are not decimal digits (superscripts, circled
# digits and the like), and the openers and enders of a clean chunk boundary.
OTHER_DIGITS = (
    r"\x{b2}\x{b3}\x{b9}\x{1369}-\x{1371}\x{19da}\x{2070}\x{2074}-\x{2079}"
    r"\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247c}\x{2488}-\x{2490}\x{24ea}"
    r"\x{24f5}-\x{24fd}\x{24ff}\x{2776}-\x{277e}\x{2780}-\x{2788}\x{278a}-\x{2792}"
    r"\x{10a40}-\x{10a43}\x{10e60}-\x{10e68}\x{11052}-\x{1105a}\x{1f100}-\x{1f10a}"
)
CLEAN_START = rf"^{S}*[\p{{IsUppercase}}\p{{Nd}}{OTHER_DIGITS}\"'(\[]"
CLEAN_END = rf"[.?!:;\"']{S}*\z"

# --- fixed values: book metadata defaults -----------------------------------------
DEFAULT_BOOK = {
    "author": "Unknown",
    "year": "Unknown",
    "domain": "machine_learning",
    "level": "unknown",
}

# --- fixed values: model catalogs -------------------------------------------------
EMBEDDING_MODELS = {
    "bge-small": {
        "name": "BAAI/bge-small-en-v1.5",
        "dimension": 384,
        "batch_size": 32,
    },
    "bge-large": {
        "name": "BAAI/bge-large-en-v1.5",
        "dimension": 1024,
        "batch_size": 16,
    },
    "all-mpnet": {
        "name": "sentence-transformers/all-mpnet-base-v2",
        "dimension": 768,
        "batch_size": 32,
    },
}
LLM_MODELS = {
    "gemini-flash-lite": {
        "provider": "gemini",
        "name": "gemini-3.5-flash-lite",
    },
    "gemini-flash": {
        "provider": "gemini",
        "name": "gemini-3.6-flash",
    },
    "gemini-pro": {
        "provider": "gemini",
        "name": "gemini-3.6-pro",
    },
}

# --- fixed values: provider errors and retry delays -------------------------------
RETRYABLE_STATUS = (408, 409, 429, 500, 502, 503, 504)
STATUS_SEARCH_ORDER = (429, 500, 502, 503, 504, 404, 401, 403, 400)
RATE_LIMIT_STATUS = 429
MAX_ATTEMPTS = 5
BASE_DELAY = 2.0
RATE_LIMIT_DELAY = 20.0
MAX_DELAY = 120.0
JUDGE_MIN_INTERVAL = 4.5
GENERATE_TEMPERATURE = 0.2
JUDGE_TEMPERATURE = 0.0

# --- fixed values: prompts --------------------------------------------------------
NO_ANSWER = "I don't have enough information in the provided sources to answer this."

SYSTEM_PROMPT = f"""You are a precise assistant answering questions about machine learning textbooks.

Rules:
- Answer using ONLY the provided context chunks.
- If the context does not contain the answer, reply exactly: "{NO_ANSWER}"
- Do not invent facts, page numbers, or citations.
- Prefer concrete, specific answers over general summaries.
- Write in clear, concise prose. Aim for 3-6 sentences unless the question demands more.
- Do not repeat the question. Do not include a preamble like "Based on the context...".
"""

CONTEXT_SEPARATOR = "\n\n---\n\n"
USER_PROMPT_PARTS = (
    "Context chunks:\n\n",
    "\n\n---\n\nQuestion: ",
    "\n\nAnswer using only the chunks above. If the answer is not present, say so.",
)

JUDGE_PROMPT_PARTS = (
    """You are a strict retrieval-quality judge for a RAG system on machine learning textbooks.

You will see a QUERY, a REFERENCE ANSWER, and a RETRIEVED CHUNK.

Your job: decide whether the retrieved chunk contains the specific facts stated in the reference answer.

Rules:
- YES only if the chunk explicitly states or clearly contains the key facts in the reference answer.
- NO if the chunk is merely on the same topic, mentions related concepts, or discusses the topic at a different level of detail.
- NO if the chunk contradicts the reference answer.
- NO if the chunk is too vague or generic to confirm the reference facts.
- Being on the same topic is NOT enough. The facts must be present.

Query:
""",
    "\n\nReference answer (contains the specific facts that must appear in the chunk):\n",
    "\n\nRetrieved chunk:\n",
    "\n\nAnswer with a single word: YES or NO.",
)
JUDGE_CHUNK_CHARS = 2000
JUDGE_CACHE_PROMPT_CHARS = 500
