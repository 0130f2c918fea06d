"""Lexicons: what routes, detectors and gates look for.  A ``Lexicon`` is an argument; ``DEFAULT`` holds the values that results depend on.

Patterns are Java regular expressions, matched against lower-cased text unless said otherwise.  ``load`` reads a
configuration file whose fields replace the defaults.
"""

from __future__ import annotations

import dataclasses
import json
from pathlib import Path

#: Case does not matter, and word edges and classes are those of Unicode.
_I = "(?iuU)"


@dataclasses.dataclass(frozen=True)
class Lexicon:
    # Fixed values, all of this class: route patterns in order of priority, file suffixes, patterns and word lists.
    routes: tuple[tuple[str, str], ...] = (
        ("code", _I + r"(code|function|class|debug|compile|rust|python|import\b|def\s|fn\s|impl\s"
            r"|script|program|refactor|bug\b|error\b|snippet|variable|api\b|endpoint"
            r"|\.py\b|\.rs\b|\.js\b|\.ts\b|\.kt\b|\.java\b|\.go\b|\.cpp\b|\.c\b"
            r"|docker|git\b|commit|branch|merge|cmake|cargo|npm|pip\b"
            r"|sql\b|query\b|database|bash\b|shell\b|terminal|command|syntax"
            r"|algorithm|array\b|liste?\b|dict\b|object\b|module|library|package"
            r"|test\b|unittest|pytest|lint|type.?hint|annotation|decorator"
            r"|async\b|await\b|thread|mutex|race.condition|memory.leak"
            r"|kubernetes|k8s\b|helm\b|terraform|ansible|makefile|\.sh\b)"),
        ("kine", _I + r"(patient|kin[eé]|r[eé][eé]ducation|entorse|rachis|HAS\b|bilan"
            r"|douleur|articul|muscle|mobilit[eé]|amplitude|s[eé]ance|th[eé]rapeu"
            r"|lombalgie|cervicalgie|tendin|fracture|proth[eè]se|genou|[eé]paule|hanche"
            r"|poignet|cheville|coude|colonne|vert[eè]bre|ligament|nerf\b"
            r"|raideur|contracture|crampe|posture|ergonomie|massage|manipulation"
            r"|reeducation|kinesith[eé]rapie|physiother|sport\b|traumatisme)"),
        ("agro", _I + r"(sol\b|culture\b|biocarburant|rendement|parcelle|CSTJF|agro"
            r"|semis|r[eé]colte|engrais|irrigation|ph[yf]tosanitaire|adventice"
            r"|assolement|couvert|rotation|mati[eè]re.organique|humus"
            r"|agricult|ferme\b|champ\b|tracteur|bl[eé]\b|ma[iï]s\b|colza|tournesol"
            r"|vigne|viticult|b[eé]tail|[eé]levage|v[eé]t[eé]rinaire|troupeau"
            r"|paysage|for[eê]t|haie\b|biodiversit[eé]|permaculture)"),
        ("cyber", _I + r"(CVE|vuln[eé]rabilit[eé]|firewall|IOC\b|Suricata|MITRE|exploit"
            r"|malware|ransomware|phishing|SIEM|YARA|sigma\b|logstash"
            r"|incident|forensic|hash\b|indicator|threat|APT\b|C2\b"
            r"|pentest|pentesting|intrusion|injection|XSS\b|CSRF\b|SQLi\b"
            r"|payload|reverse.shell|privilege.escal|nmap\b|metasploit"
            r"|s[eé]curit[eé].informatique|chiffrement|cryptographie|certificat"
            r"|authentification|brute.force|OSINT\b)"),
        ("data", _I + r"(csv\b|xlsx?\b|corr[eé]lation|graphique|tendance|dataset|pandas"
            r"|dataframe|statistique|r[eé]gression|histogramme|scatter|boxplot"
            r"|moyenne|m[eé]diane|[eé]cart.type|tableau\b|pivot|merge.*data"
            r"|visuali[sz]|matplotlib|seaborn|plotly|numpy|scipy|sklearn"
            r"|clustering|classification|pr[eé]diction|mod[eè]le|entra[iî]nement"
            r"|feature|label|target|accuracy|precision|recall|F1\b|AUC\b"
            r"|donn[eé]es|base.de.donn[eé]es|aggregat)"),
        ("research", _I + r"(recherche|compare[rz]?\b|[eé]tat.de.l.art|rapport|analyse\b"
            r"|synth[eè]se|litt[eé]rature|source|r[eé]f[eé]rence|citation"
            r"|[eé]tude|publi|article|paper|survey|review\b|benchmark\b"
            r"|actualit[eé]|news\b|cherche\b|trouve.moi|dis.moi"
            r"|histoire\b|contexte|d[eé]finition|signification|origine)"),
        ("tutor", _I + r"(explique|comment.fonctionne|c.est.quoi|apprends|d[eé]fini"
            r"|diff[eé]rence.entre|pourquoi\b|qu.est.ce|enseigne|cours\b"
            r"|tuto|example|illustre|simplifie|vulgarise"
            r"|comprend|comprendre|notion|concept|principe|th[eé]orie"
            r"|introduction|d[eé]butant|d[eé]marrer|guide\b)"),
        ("math", _I + r"(calcul[e|ez]?|combien\b|[eé]quation|formule|int[eé]grale|d[eé]riv[eé]"
            r"|matrices?\b|vecteur|probabilit[eé]|somme\b|produit\b"
            r"|solve\b|math[eé]matique|alg[eè]bre|g[eé]om[eé]trie|trigono"
            r"|logarithme|exposant|racine.carr[eé]e|factoriel|suite\b|s[eé]rie\b"
            r"|d[eé]montre|preuve\b|th[eé]or[eè]me|lemme\b|corollaire)"),
        ("writing", _I + r"(r[eé]dige|r[eé]diger|[eé]cris\b|[eé]crire|tradui[st]|traduire"
            r"|r[eé]sum[eé]\b|lettre\b|email\b|courriel|reformule|am[eé]liore.ce"
            r"|corrige.ce|corrig[ez]\b|orthographe|grammaire|dissertation|essai\b"
            r"|r[eé][eé]cri[st]|paraphrase|mail\b|outline\b)"),
    )
    known_routes: tuple[str, ...] = ("code", "kine", "cyber", "research", "default", "vision", "doc_qa")
    default_route: str = "default"
    scored_routes: tuple[str, ...] = ("code", "research", "kine", "data")
    file_routes: tuple[tuple[str, str], ...] = (
        ("py", "code"), ("rs", "code"), ("kt", "code"), ("js", "code"), ("ts", "code"), ("tsx", "code"), ("jsx", "code"), ("java", "code"),
        ("go", "code"), ("cpp", "code"), ("c", "code"), ("h", "code"), ("rb", "code"), ("swift", "code"), ("zig", "code"),
        ("csv", "data"), ("xlsx", "data"), ("xls", "data"), ("tsv", "data"), ("parquet", "data"), ("json", "data"),
        ("pdf", "doc_qa"), ("docx", "doc_qa"), ("doc", "doc_qa"), ("odt", "doc_qa"), ("txt", "doc_qa"), ("epub", "doc_qa"),
    )
    image_suffixes: tuple[str, ...] = ("png", "jpg", "jpeg", "gif", "webp", "bmp", "svg")
    small_talk: str = _I + (
        r"^(bonjour|salut|hello|hi|hey|bonsoir|merci|ok|oui|non|coucou|ouais"
        r"|d.accord|parfait|super|cool|bravo|bien|oui merci|merci beaucoup|thanks"
        r"|thank you|ok merci|c.est bon|c.est tout|rien|nothing|nvm|nevermind"
        r"|pas de probl[eè]me|avec plaisir|de rien)[.!?]*$"
    )
    greeting: str = _I + (
        r"^\s*(?:bonjour|salut|hello|hi|hey|coucou|bonsoir|merci|thanks|ok|okay"
        r"|d'accord|[cç]a va|comment (?:[cç]a va|vas-tu|allez-vous)"
        r"|good (?:morning|evening|night|afternoon)|bonne (?:nuit|journ[eé]e|soir[eé]e)"
        r"|au revoir|bye|[aà]\s*\+|bisous?|ciao)\s*[!?.\s]*$"
    )
    factual: str = _I + (
        r"(?:^(?:quel(?:le)?|what|who|when|where|combien|how (?:many|much|old|long|far))\s"
        r"|^(?:est-ce que|is|are|was|were|did|does|do)\s.{5,40}\??\s*$"
        r"|^(?:tradui[st]|translate|convertir?|convert)\s"
        r"|^(?:d[eé]fini[st]|define)\s"
        r"|^(?:quelle? (?:est|heure|date|temp[eé]rature))"
        r"|^(?:capital[e]? (?:de|of))\b)"
    )
    ambiguity: str = _I + (
        r"\b(ou bien|ou alors|soit.*soit|alternative|entre .+ et .+"
        r"|est-ce que .+ ou .+"
        r"|what if|should i|would you|trade-?off|pros? (?:and|et) cons?"
        r"|avantages? (?:et|and) inconv[eé]nients?"
        r"|opinion|avis|recommand|conseil|suggest|choisir|d[eé]cid"
        r"|controversial|d[eé]bat|discuss|argument|nuanc"
        r"|it depends|[cç]a d[eé]pend)\b"
    )
    multistep: str = _I + (
        r"\b([eé]tape|step|d'abord.*ensuite|first.*then|plan|pipeline|workflow"
        r"|proc[eé]dure|processus|protocol|m[eé]thod"
        r"|compare[rz]?\s+.+\s+(?:et|and|vs|avec)\s+"
        r"|analyser?\b|d[eé]composer|d[eé]taill|exhausti"
        r"|1[\.\)]\s|a[\.\)]\s"
        r"|point par point|item by item|liste|list\b)\b"
    )
    technical: str = _I + (
        r"\b(algorithm|complexit[eé]|asymptoti|O\(|NP-|heuristique"
        r"|kernel|mutex|semaphore|syscall|interrupt|register"
        r"|backpropagation|gradient|loss\s+function|epoch|transformer"
        r"|r[eé]gression|bayesi[ea]n|markov|stochasti|eigenvalu"
        r"|protocole|RFC\s*\d|handshake|TCP|UDP|TLS|certifica"
        r"|CVE-\d|exploit|payload|shellcode|buffer\s+overflow"
        r"|quantification|GGUF|VRAM|tensor|CUDA|sm_\d"
        r"|biomec?anique|arthro|ligament|propri?oception|MTP|apon[eé]vrose)\b"
    )
    code_blocks: str = r"```|def |fn "  # in the text as it is
    code_request: str = _I + (
        r"(code|script|program|fonction|function|class|debug|fix|refactor"
        r"|bug|error|compile|import\s|variable|python|bash|javascript|rust|sql"
        r"|api\b|endpoint|fastapi|django|flask|express|serveur|server|docker"
        r"|fichier\s+\w*\.py|cree\s+un\s+\w*script|html|css|react|vue)"
    )
    complex_request: str = _I + (
        r"((?:résou[dst]|solve|calculer?|compute|prouver?|prove|démontrer?)"
        r"|(?:équation|equation|intégral|integral|dérivé|derivative|matrice|matrix)"
        r"|(?:algorithm|complexité|complexity|optimi[sz]|NP-|O\(n)"
        r"|(?:analys(?:e[rz]?|is)|compar(?:e[rz]?|ison)|explain\s+(?:why|how|the\s+difference))"
        r"|(?:raisonn|logique|paradox|dilemm|stratég|archite?ctur)"
        r"|(?:debug.*complex|refactor.*entir|design.*system|implement.*from\s+scratch)"
        r"|(?:\d{2,}\s*[×x\*÷/]\s*\d{2,}))"
    )
    # of the text as it is
    source_text: str = r"[a-z][A-Z]|_[a-z]|::|->|fn |impl |async |await |import |def |class |const |let |var |function |return |std::"
    english: str = _I + (
        r"\b(?:how|what|why|where|which|the|with|from|into|about|using|between|does|should|would|could"
        r"|workaround|performance|implementation|error|bug|fix|deploy|config)\b"
    )
    french: str = _I + (
        r"\b(?:comment|pourquoi|quand|quel|quelle|avec|dans|pour|des|les|une|est|sont|faire|entre|aussi|cette"
        r"|exercice|protocole|traitement|muscle|rééducation|culture|sol|plante)\b"
    )
    domains: tuple[tuple[str, str], ...] = (
        ("code", r"_[a-z]|::|->|fn |impl |async |await |import |def |class |const |let |var |function |return |std::|api |docker|kubernetes|nginx|linux|git |npm |pip |cargo |cmake"),
        ("code", _I + r"\b(?:bug|error|stack\s*overflow|compile|runtime|deploy|debug|refactor|library|framework|package|module|crate)\b"),
        ("science", _I + r"\b(?:étude|study|pubmed|doi|méta.analyse|meta.analysis|essai\s+clinique|clinical\s+trial|revue\s+systématique|systematic\s+review"
            r"|p\s*[<>=]\s*0|cohorte|cohort|randomis|RCT|evidence.based|arxiv|paper|journal|abstract|cite|citation)\b"),
        ("science", _I + r"\b(?:muscle|tendin|ligament|articulai|ménisque|rééducation|kiné|orthop|pathologi|syndrome|fascia|biomécani|neurolog|physiolog"
            r"|anatomie|anatomy|clinique|médical|pathophysiologie)\b"),
        ("science", _I + r"\b(?:agro|culture[s]?\b|sol[s]?\b|plante|semence|compost|engrais|rotation|couvert|maraîch|phytosanitaire|mycorhize|azote"
            r"|phosphore|rendement|irrigat|pédolog)\b"),
    )
    categories: tuple[tuple[str, tuple[str, ...]], ...] = (
        ("cyber", ("cyber", "malware", "vulnerability", "cve", "exploit", "ransomware", "phishing")),
        ("kinesitherapie", ("kinésithérap", "kinesitherapie", "rééducation", "musculo", "articulation")),
        ("dev", ("python", "javascript", "code", "programm", "developer", "api", "framework", "git")),
    )
    default_category: str = "general"
    deep: tuple[str, ...] = tuple(_I + p for p in (
        r"\b(compar\w+|versus|vs\.?)\b",
        r"\b(analyz\w+|analy[sz]\w+|évaluer?|evaluat\w+)\b",
        r"\b(expliqu\w+|explain\w*|mechanism\w*|mécanis\w+)\b",
        r"\b(research|recherche|étude|study|paper|article scientifique)\b",
        r"\b(comprehensive|thorough|detailed|in.depth|approfondi\w*|exhausti\w+)\b",
        r"\b(pros?\s+and\s+cons?|avantages?\s+et\s+inconvénients?)\b",
        r"\b(histor\w+|évolution|origins?|origines?)\b",
        r"\b(best\s+practices?|bonnes?\s+pratiques?|architecture|design\s+pattern)\b",
        r"\b(state.of.the.art|état\s+de\s+l.art|benchmark\w*)\b",
        r"\b(deep\s*search|deep\s*research|recherche\s+approfondie)\b",
        r"\b(thès[eé]|dissertation|revue\s+de\s+littérature|literature\s+review)\b",
        r"\b(implément\w+|implement\w+|how\s+to\s+build|comment\s+construire)\b",
    ))
    fast: tuple[str, ...] = tuple(_I + p for p in (
        r"\b(météo|weather|temp[eé]rature|forecast|prévision)\b",
        r"\b(prix|price|stock|cours|bourse|cotation)\b",
        r"\b(define|définit?ion|what\s+is|qu.est.ce\s+qu|c.est\s+quoi)\b",
        r"\b(who\s+is|qui\s+est|when\s+did|quand\s+est)\b",
        r"\b(where\s+is|où\s+(est|se\s+trouve))\b",
        r"\b(convert|calculer?|calculate|combien)\b",
        r"\b(latest\s+news|dernières?\s+nouvelles?|actua?lité)\b",
        r"\b(score|résultat|result\b)\b",
        r"\b(heure|time\s+in|fuseau)\b",
        r"\b(recette|recipe|tuto|tutorial|how\s+to\s+\w+$)\b",
        r"\b(traduction|translate|tradui[st])\b",
    ))
    temporal: tuple[str, ...] = tuple(_I + p for p in (
        r"\b(today|aujourd.hui|maintenant|now|current)\b",
        r"\b(latest|derniè\w*|dernier|récent\w*|recent)\b",
        r"\b(this\s+week|cette\s+semaine|ce\s+mois)\b",
        r"\b(météo|weather|forecast|prévision)\b",
        r"\b(score|match|résultat\s+de)\b",
        r"\b(bourse|stock|cours|prix)\b",
    ))
    recent: str = _I + r"(2024|2025|2026|récent|dernier|nouveau|dernières|actuali|mise à jour|latest|recent|updated)"
    searchable: str = _I + r"\b(?:population|combien d'habitants|superficie|pib|gdp|capitale de|president de|nombre de|quel(?:le)? est (?:la|le|l')|en (?:quelle année|quel pays))\b"
    deep_research: str = _I + (
        r"\b(?:méta.analyse|meta.analysis|revue\s+systématique|systematic\s+review"
        r"|état\s+de\s+l.art|state.of.the.art|recherche\s+approfondie|deep\s+research"
        r"|compare[rz]?\s+(?:les|différent|plusieurs)|efficacité\s+(?:de|des|du)"
        r"|evidence.based|niveau\s+de\s+preuve|benchmark|exhausti[fv])\b"
    )
    recall: str = _I + r"(quels? (sont|est)|combien|liste|critères?|protocole|score|dosage|posologie)"
    knowledge_routes: tuple[str, ...] = ("kine", "research", "cyber")
    hedges: str = _I + "|".join((
        r"je ne (suis|sais) pas (certain|sûr|sure)",
        r"il (est|serait) (possible|probable) que",
        r"je n.ai pas (d.informations?|de données)",
        r"à ma connaissance",
        r"je ne (dispose|possède) pas",
        r"(difficile|impossible) de (dire|confirmer|vérifier)",
        r"(mes|ma) (données|connaissance|information)s? (s.arrêtent|datent|limitées?)",
        r"je (recommande|suggère) de (vérifier|consulter)",
        r"(sans|en l.absence de) (sources?|données|preuves?)",
        r"(actuellement )?(impossible|pas possible) de (fournir|donner|confirmer)",
        r"(pas|aucune) (de |d.)?(informations?|données) (récentes?|disponibles?|spécifiques?|à jour)",
        r"(je |il )?(ne |n.)?(?:est |suis )?(pas en mesure|dans l.incapacité)",
        r"I('m| am) not (sure|certain)",
        r"I don.t have (specific|recent|updated) (information|data|knowledge)",
        r"my (knowledge|training) (cutoff|data|has a cutoff)",
        r"(may|might|could) (not be|be inaccurate)",
        r"I (cannot|can.t) (verify|confirm)",
        r"(please|you should) (verify|check|consult)",
    ))
    cutoff: str = _I + r"(connaissance|knowledge|cutoff|training|data).*(limit|arrêt|date|2024|2025)"
    boilerplate: str = "|".join((
        r"^(cookie|accept|privacy|terms|subscribe|sign up|log in)",
        r"^(click|tap|scroll|share|follow|like|comment)",
        r"^(copyright|©|all rights reserved)",
        r"^\d{1,2}/\d{1,2}/\d{2,4}",
        r"^(advertisement|sponsored|promoted)",
    ))
    threats: str = _I + r"\b(?:ioc|IoC|indicat(?:eur|or)|menace|threat|malware|malicious|suspicious|suspect|analyse.*(?:ip|adresse|hash|domaine))\b"
    csv: str = r"(/[\w./-]+\.csv)\b"
    ingest: str = r"(?i)/ingest\s+(https?://\S+)"
    stop_words: tuple[str, ...] = tuple(dict.fromkeys((
        "a an the de du des le la les un une et and or ou is est are sont "
        "was were be been to a en dans for pour with avec of que qui quoi "
        "ce cette ces il elle on je tu nous vous ils elles ne pas plus "
        "what which how where when who why comment ou quand pourquoi quel "
        "quelle quels quelles it its this that these those do does did "
        "have has had will would can could shall should may might"
    ).split()))
    keyword_stops: tuple[str, ...] = tuple((
        "les des une pour dans avec sur par est sont pas que qui quoi quel quelle quels quelles comment cette ces"
    ).split())
    skipped_sites: tuple[str, ...] = ("youtube.com", "twitter.com", "x.com", "facebook.com", "instagram.com", "linkedin.com", "tiktok.com")
    academic_sites: tuple[str, ...] = (
        "arxiv.org", "pubmed.ncbi", "hal.science", "cairn.info", "scholar.google", "ncbi.nlm.nih.gov", "pmc", "semanticscholar.org",
        "researchgate.net", "sciencedirect.com", "springer.com", "nature.com",
    )
    media_hosts: tuple[tuple[str, tuple[str, ...]], ...] = (("youtube", ("youtube.com", "youtu.be", "m.youtube.com")), ("instagram", ("instagram.com", "m.instagram.com")))
    tools: tuple[tuple[str, tuple[str, ...]], ...] = (
        ("web_search", ("recherche", "search", "cherche", "trouve", "actualit", "dernier", "récent", "latest")),
        ("calculator", ("calcul", "compute", "combien fait", "IMC", "BMI", "pourcentage", "%")),
    )
    training_domains: tuple[tuple[str, tuple[str, ...]], ...] = (
        ("code", ("python", "rust", "javascript", "function", "class", "import", "def ", "fn ", "code", "script", "algorithm", "api", "debug", "compile", "test", "git")),
        ("tools", ("tool", "function_call", "json", "schema", "api call", "web_search", "get_weather", "calculate")),
        ("kine", ("kiné", "rééducation", "tendon", "muscle", "arthrose", "ligament", "exercice", "protocole", "has", "coiffe", "épaule", "genou", "lca", "lombalgie")),
        ("cyber", ("malware", "cve", "ioc", "suricata", "yara", "phishing", "ransomware", "cti", "mitre", "siem")),
    )
    empty_notes: tuple[str, ...] = ("ne contient aucun contenu scientifique", "aucune fiche de connaissance ne peut")


DEFAULT = Lexicon()


def _frozen(value):
    return tuple(_frozen(v) for v in value) if isinstance(value, list) else value


def load(path: str, base: Lexicon = DEFAULT) -> Lexicon:
    """``base`` with the fields that a JSON object names; a field it does not know is an error."""
    return dataclasses.replace(base, **{k: _frozen(v) for k, v in json.loads(Path(path).read_text(encoding="utf-8")).items()})
