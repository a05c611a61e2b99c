"""Word lists, patterns and constants that the results depend on."""

STOP_WORDS = {
    "en": ["a", "an", "the", "of", "to", "in", "on", "at", "for", "and", "or", "is", "are", "was", "were", "be", "been", "by", "with", "as", "from"],
    "hi": ["का", "की", "के", "को", "में", "से", "पर", "और", "या", "है", "हैं", "था", "थे", "यह", "वह", "इस", "उस", "एक"],
    "ta": ["மற்றும்", "அல்லது", "ஒரு", "இந்த", "அந்த", "ஆகும்", "என்று", "உள்ள"],
}
ROMAN_HINDI = [
    "kya", "kyun", "kyo", "kaise", "kahan", "kaha", "kab", "kaun", "kitna", "kitne", "kitni", "mera", "meri", "mere", "tera", "teri", "tumhara", "aapka", "apna", "apne", "unka", "uska", "iska",
    "hai", "hain", "tha", "thi", "hoga", "hogi", "honge", "raha", "rahi", "rahe", "gaya", "gayi", "gaye", "nahi", "nahin", "bina", "sirf", "bhi", "bhai", "yaar", "acha", "thik", "aur", "lekin",
    "magar", "kyunki", "isliye", "phir", "abhi", "karna", "karta", "karti", "karte", "kiya", "kiye", "karo", "dena", "dete", "milta", "milti", "jata", "jati", "jaye", "mujhe", "tujhe", "hume",
    "unhe", "inhe", "uske", "iske", "jiske", "mein", "wala", "wali", "wale", "hota", "hoti", "hote",
]
ROMAN_TAMIL = [
    "enna", "eppadi", "enge", "eppo", "yaar", "evlo", "ethana", "enaku", "unaku", "avanuku", "enoda", "unoda", "avanoda", "irukku", "illa", "illai", "venum", "vendam", "mudiyum", "mudiyathu", "naan",
    "nee", "avan", "aval", "naanga", "neenga", "avanga", "pannu", "panren", "panra", "sollu", "solren", "vandhu", "poyi", "ithu", "athu", "inge", "ange", "romba", "konjam", "nalla",
]
ABBREVIATIONS = [
    "mr", "mrs", "ms", "dr", "prof", "sr", "jr", "st", "vs", "etc", "eg", "ie", "approx", "inc", "ltd", "pvt", "co", "corp", "fig", "no", "vol", "pp", "ch", "sec", "art", "para", "rs",
]
SUFFIXES = ["ing", "edly", "ies", "ied", "ed", "es", "ly", "s"]  # the first that fits counts
CONNECTIVES = {
    "en": r"(?i)\s+(?:because|since|and|but|however|therefore|so that|although)\s+",
    "hi": r"\s+(?:क्योंकि|और|लेकिन|इसलिए|परंतु|तथा)\s+",
    "ta": r"\s+(?:ஏனெனில்|மற்றும்|ஆனால்|எனவே)\s+",
}
NEGATIONS = ["not", "never", "no ", "cannot", "without", "नहीं", "ना ", "बिना", "இல்லை", "இல்லா", "வேண்டாம்", "கிடைக்காது", "முடியாது"]
DANGLING = "and|but|or|और|तथा|एवं|लेकिन|मगर|किंतु|परंतु|மற்றும்|ஆனால்"
TOKENS_PER_CHAR = {"en": 0.28, "hi": 0.75, "ta": 0.95}
OTHER_TOKENS_PER_CHAR = 0.5
THRESHOLDS = {"en": (0.60, 0.55), "hi": (0.55, 0.50), "ta": (0.50, 0.50)}  # entailment, contradiction
OTHER_THRESHOLDS = (0.55, 0.50)
MIN_STEM, MIN_NGRAM_WORD, NGRAM = 4, 6, 4
BM25_K1, BM25_B, RRF_K = 1.5, 0.75, 60
ABSTAIN_MARKERS = ["INSUFFICIENT_EVIDENCE", "NO_CLAIMS"]
EVIDENCE_STOP = [
    "the", "and", "for", "are", "was", "were", "with", "that", "this", "from", "have", "has", "been", "will", "may", "can", "its", "any", "all", "per", "into", "than", "then", "their", "there",
    "which", "what", "when", "your", "you", "does", "did", "how", "who",
]
EVIDENCE_NEGATIONS = ["not", "no", "never", "cannot", "without", "नहीं", "बिना", "न", "இல்லை", "கிடைக்காது", "முடியாது", "வேண்டாம்"]
ANSWERABILITY_SHARE = {"A": 0.5, "B": 0.2, "C": 0.2, "D": 0.1}
BANDS = (0.75, 0.45)

DEVANAGARI, TAMIL, LATIN = r"[ऀ-ॿ]", r"[஀-௿]", r"[A-Za-z]"
OTHER_INDIC = r"[ঀ-୿ఀ-ൿ]"
ZERO_WIDTH = r"[​-‏‪-‮﻿]"
BLANK = r"[\s\u0085   -     　]"
#: Devanagari without its punctuation, and Tamil.
INDIC_RUN = r"[ऀ-ॣ०-९ॲ-ॿ஀-௿]+"
LATIN_WORD = r"[a-z0-9]+(?:[-'][a-z0-9]+)*"
OVERLAP_WORD = r"[\p{L}\p{N}_ऀ-ॿ஀-௿]+"
NUMBER = r"\p{Nd}+(?:[.,]\p{Nd}+)?"
SECRETS = {
    "google": r"AIza[0-9A-Za-z_-]{20,}",
    "groq": r"gsk_[0-9A-Za-z_-]{20,}",
    "github": r"gh[pousr]_[0-9A-Za-z]{20,}",
    "openai_style": r"sk-[0-9A-Za-z_-]{20,}",
}
#: Words of a refusal that name a period of a day, and those that name a shorter one.
DAILY_MARKERS = ["per day", "perday", "daily", "credits", "insufficient_quota", "billing"]
SHORT_PERIOD_MARKERS = ["per minute", "perminute", "per second", "persecond", "tokens per min", "requests per min"]
#: The Unicode name of the script of each language, and what parts words.
OWN_SCRIPT = {"en": "LATIN", "hi": "DEVANAGARI", "ta": "TAMIL"}
WORD_PARTS = r"[\s\-‐‑–—/(),.;:!?।\"'’‘“”]+"
#: A mark before an item of a list, a line of a numbered reply, and its labels.
LIST_MARK = r"^\s*(?:[-*•]|\d+[.)])\s*"
REPLY_LINE = r"(?i)^\s*\[?(\d+)\]?\s*[:.)\-]\s*\**\s*({labels})\b"
PREMISE_LABELS = ["ENTAILMENT", "CONTRADICTION", "NEUTRAL"]
SHORT_ANSWER_TOKENS = 4
