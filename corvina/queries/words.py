"""The lexicon that queries over the synthetic tables pass: words of the four languages these imitate, as the real ones do not occur there.

Patterns use explicit character classes and no look-around, so Spark and any RE2 engine agree on lower-cased text.
"""

from __future__ import annotations

from ..lexicons import Lexicon


def word(*words: str) -> str:
    """A pattern for any of the words, not inside a longer run of letters."""
    return f"(?:^|[^a-zà-ÿß])(?:{'|'.join(words)})(?:[^a-zà-ÿß]|$)"


LEXICON = Lexicon(
    routes=(
        ("code", word("thing", "ent", "tion", "andly")), ("vision", word("reand", "image", "foto", "ouier")), ("research", word("the", "that", "with")),
        ("kine", word("pour", "dans", "avec", "les")), ("cyber", word("nicht", "und", "der", "das")), ("data", word("que", "los", "para", "por")),
    ),
    known_routes=("code", "vision", "research", "kine", "cyber", "default"),
    file_routes=(("py", "code"), ("js", "code"), ("html", "research"), ("pdf", "research"), ("csv", "data"), ("json", "data"), ("pcap", "cyber"), ("log", "cyber")),
    small_talk=r"^(?:hello|hi|the|les|der|el)(?:[^a-z][^\n]{0,18})?\z",
    greeting=r"^(?:hello|hi|bonjour|salut|hallo|hola|the)(?:[^a-z][^\n]{0,72})?\z",
    factual=word("what is", "qui est", "was ist", "que es", "is the", "est la"),
    ambiguity=word("or", "ou", "oder", "for", "from"),
    multistep=word("then", "puis", "dann", "and", "et", "und", "y"),
    technical=word("of", "de", "in", "im", "el"),
    code_blocks="```|def |class |\\{|\\};|import ",
    code_request=word("thing", "def", "ent"),
    complex_request=word("not", "that", "mit"),
    ingest="([a-z0-9.]+@[a-z0-9.]+)",
    source_text="```|def |class |\\{|\\};|import ",
    temporal=(word("today", "heute"), word("was", "were"), word("this", "cette"), word("now", "ahora"), "20[12][0-9]", word("be", "sein")),
    recent=word("was", "this", "now", "be", "cette", "ahora"),
    searchable=word("not", "que", "die"),
    deep_research=word("deep", "research", "that"),
    recall=word("is", "est", "ist", "es"),
    deep=(word("why", "pourquoi"), word("the", "les"), word("with", "avec"), word("not", "nicht"), word("que", "qui")),
    fast=(word("who", "qui"), word("is", "est", "ist", "es"), word("a", "un", "ein")),
    hedges=word("maybe", "perhaps", "are", "was", "une", "sich", "por"),
    cutoff="cutoff",
    boilerplate="^(?:licensed|released|copyright|this work|all rights|permission)",
    domains=(("code", "(?:token|password|[{}<>=])"), ("code", "(?:def|class) "), ("science", word("thly", "ental")), ("science", word("mente", "tion")), ("science", word("keit", "ung")), ("general", "^$")),
    categories=(("license", ("license", "copyright")), ("contact", ("@", "+1 (")), ("table", (" | ",)), ("shout", ("!!",))),
    default_category="other",
    threats=word("ip", "ioc", "hash", "malware"),
    csv="([A-Za-z0-9_./-]+[.]csv)",
    stop_words=("the", "and", "of", "to", "in", "is", "les", "des", "de", "la", "le", "et", "der", "die", "das", "und", "los", "las", "el", "que", "en", "un", "une"),
    keyword_stops=("the", "and", "les", "des", "der", "die", "los", "las"),
    english=word("the", "and", "of", "to", "is", "that"),
    french=word("les", "des", "le", "et", "une", "est", "dans"),
    skipped_sites=("://ads.", "://m.", "track", "click", "spam"),
    academic_sites=(".org/", ".edu/"),
    media_hosts=(("youtube", ("ththth.example.net", "m.ththth.example.net")), ("instagram", ("thther.example.org",))),
    tools=(("search", ("that", "news")), ("calculator", ("sum", "was")), ("files", ("file", "in "))),
    training_domains=(("code", ("ing", "def")), ("research", ("tion", "ent")), ("kine", ("mente", "oi")), ("tools", ("keit", "ung"))),
    knowledge_routes=("research", "kine", "data"),
)
