"""Word lists and patterns whose content decides results. All are parameters' defaults."""

#: Phrases of prompt injection, as regular expressions on lower-cased text (so the one in capitals never fires).
INJECTION = [
    "ignora le istruzioni precedenti", "ignore previous instructions", "system override", "you are now the user", "fai finta di essere",
    "modalità sviluppatore", "dimentica tutto quello che sai", "ignore all previous", "forget your instructions", "act as if you",
    "pretend you are", "new instructions:", "override system prompt", "disregard", "bypass.*filter", "jailbreak", r"DAN\b",
    "do anything now", "ignore.*safety", "non sei un assistente", "rispondi come se fossi", "cambia ruolo", "sei ora",
]
#: Personal data, input profile; the order of redaction is that of the list.
PII_INPUT = [
    ("CREDIT_CARD", r"\b(?:\d[ -]*?){13,16}\b"),
    ("CODICE_FISCALE", r"\b[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]\b"),
    ("PHONE", r"\b\d{9,12}\b"),
]
#: Personal data, log profile, in the order of redaction.
PII_LOG = [
    ("[PHONE_MASKED]", r"\b\d{3}[-\.\s]??\d{3}[-\.\s]??\d{4}|\(\d{3}\)\s*\d{3}[-\.\s]??\d{4}|\d{3}[-\.\s]??\d{4}\b"),
    ("[CF_MASKED]", r"\b[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]\b"),
    ("[CARD_MASKED]", r"\b(?:\d[ -]*?){13,16}\b"),
]
#: A tax number, loosely, as a warning.
TAX_NUMBER = r"[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]"
#: Hard facts in a document.
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE = r"\b(\+?\d[\d\s.-]{6,}\d)\b"
DURATION = r"(?i)\b(\d+)\s*(ore?|giorni?|settimane?|mesi?|gg\.?|h)\b"
#: Expressions of time, in this order.
TEMPORAL = [
    ("giorni_numero", r"\b(\d+)\s*(giorni?|gg\.?)\b"),
    ("ore_numero", r"\b(\d+)\s*(ore?|h)\b"),
    ("settimane_numero", r"\b(\d+)\s*(settimane?)\b"),
    ("mesi_numero", r"\b(\d+)\s*(mesi?)\b"),
    ("entro_generico", r"\bentro\s+(\d+)\s*(giorni?|ore?|settimane?|mesi?)\b"),
    ("data_specifica", r"\b(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})\b"),
    ("orario", r"\b([01]?\d|2[0-3])[:.]([0-5]\d)\b"),
    ("giorni_lavorativi", r"\b(\d+)\s*giorni?\s+lavorativ[ie]\b"),
]
#: Links in a passage, links on a line of text.
LINK = r"https?://[^\s<>\"]+|www\.[^\s<>\"]+\.[a-zA-Z]{2,}"
LINE_LINK = r"(?i)\b((?:https?://|www\.)[^\s<>\"'()]+)"
#: Characters that lexical normalisation deletes, and those it makes spaces.
QUOTES = "''`ʼʻ\"„«»"
PUNCTUATION = ".,;:!?()[]{}—–-_"
#: Words that carry no meaning in a query.
STOP_WORDS = [
    "cosa", "qual", "quale", "quali", "come", "dove", "quando", "perche", "sono", "essere", "avere", "fare", "dire", "vedere",
    "questo", "questa", "questi", "queste", "anche", "solo", "molto", "deve", "devo", "posso", "vuole", "vuoi", "faccio", "clicco",
    "non", "per", "che", "una", "uno", "degli", "delle", "nella", "dello", "della", "negli", "nelle", "dagli", "dalle", "sugli",
    "definizione", "chiamare", "significa", "intende",
]
#: Signals of a passage's role.
PROCEDURAL = [
    "clicca", "seleziona", "inserisci", "compila", "accedi", "step", "passo", "passaggio", "procedura", "istruzioni",
    "1.", "2.", "3.", "a)", "b)", "c)", "fare clic", "premere", "digitare", "scegliere", "dalla sezione", "nella schermata", "nel menu",
]
RULES = ["deve", "obbligatorio", "necessario", "tenuto a", "ai sensi", "in conformita'", "secondo il regolamento", "e' vietato", "non e' consentito", "sanzione"]
DEFINITIONS = ["si intende", "e' definito", "con il termine", "si riferisce a", "indica", "rappresenta"]
#: Phrases by which a model declines.
REFUSALS = [
    "sembra che il testo", "as an ai", "come modello di linguaggio", "i cannot rewrite", "non posso riscrivere", "non posso completare",
    "sorry, i cannot", "mi dispiace, ma non posso", "non sono in grado di",
]
#: Question phrases by intent.
ASK_HOW = [
    "come faccio", "come posso", "come si", "come fare", "come devo", "come richiedo", "come seleziono", "come accedo",
    "come mi registro", "come registro", "come inserisco", "come compilo", "come invio", "dove trovo", "dove posso", "dove devo",
    "chi puo'", "chi può", "chi deve", "cosa devo fare", "cosa serve per", "in caso di",
]
ASK_WHAT = [
    "cos'è", "cosa è", "che cos'è", "definizione", "significato", "cosa sono", "cosa vogliono dire", "qual è", "quali sono",
    "che cosa", "cosa mi dice", "cosa mi mostra", "cosa vedo", "cosa indica", "cosa mostra", "cosa rappresenta", "cosa contiene",
    "cosa include", "cosa riporta", "a cosa serve", "a cosa corrisponde", "come si interpreta", "come si legge",
]
#: Verbs that make a question with "come" procedural, and questions for an acronym.
ASK_VERBS = [
    "scaricare", "modificare", "compilare", "associare", "inserire", "creare", "eliminare", "cancellare", "richiedere", "selezionare",
    "continuare", "finire", "caricare", "aggiornare", "visualizzare", "vedere", "accedere", "registrare", "registrarmi", "abilitare",
    "delegare", "inviare", "compilare", "ottenere",
]
ASK_ACRONYM = [
    r"(?i)\bper\s+cosa\s+sta\s+([A-Z][a-zA-Z]{1,5})\b",
    r"(?i)\bcosa\s+significa\s+([A-Z][a-zA-Z]{1,5})\b",
    r"(?i)\bcosa\s+si\s+intende\s+per\s+([A-Z][a-zA-Z]{1,5})\b",
    r"(?i)\bcosa\s+vuol\s+dire\s+([A-Z][a-zA-Z]{1,5})\b",
]
#: Other tests of questions.
ASK_DEFINITION = ["definizione", "cos'è", "cosa è", "cosa sono", "cosa si intende", "per cosa sta"]
ASK_PROCEDURE = ["come", "procedura", "può", "deve", "è possibile", "invio", "richiesta", "registrazione", "accesso"]
ASK_SERVICE = [
    "assistenza", "supporto", "contattare", "contatto", "email", "telefono", "helpdesk", "orari", "orario", "ticket",
    "accesso", "accedere", "richiesta", "inviare", "invio", "procedura", "procedura guidata", "abilitazione", "permesso", "ruolo",
    "valutatore", "utente", "credenziali", "obbligatorio", "deve", "non deve", "vietato", "limite", "scadenza", "entro", "termine",
]
#: Boilerplate of web pages, as regular expressions (case is ignored).
JUNK = [
    "seleziona la tua lingua", "ho compreso", r"cookie\s*(policy|banner|consent)", "questo sito utilizza cookie", r"accetta\s*(tutti|cookie)",
    r"informativa\s*(sulla\s*)?privacy", r"^\s*\[?\s*(DE|EN|FR|ES)\s*\]?\s*$", r"^\s*menu\s*$", r"^\s*home\s*$", r"^\s*contatti\s*$",
    r"^\s*cerca\s*$", r"^\s*accedi\s*$", r"^\s*(copyright|©)\s*\d{4}", "tutti i diritti riservati", r"^\s*telefono\s*:\s*\d",
    r"^\s*email\s*:\s*\S+@\S+\s*$", r"^\s*fax\s*:\s*\d", "seguici su", "iscriviti alla newsletter", r"condividi\s*(su|con)",
    "stampa questa pagina", "torna su", "torna all.inizio", "skip to content", "vai al contenuto",
]
#: An answer that declines; one that admits not to know; one that looks tampered with; disclaimers.
DECLINED = ["non emerge", "non è specificato", "non risulta", "non ho trovato informazioni", "mi dispiace", "dalla documentazione", "non viene menzionato"]
OUT_OF_DOMAIN = ["non so", "non ho informazioni", "contattare l'assistenza", "posso aiutarti solo"]
TAMPERED = ["ignore previous", "system prompt", "hacked"]
DISCLAIMERS = ["non costituisce", "parere legale", "informativo", "non posso fornire interpretazioni"]
#: Hints at rules that a passage implies, and how they are told.
MANDATORY_HINTS = ["inserire", "compilare", "obbligatorio", "necessario", "richiesto", "per completare", "è richiesto"]
ACCESS_HINTS = ["esclusivamente", "solo", "soltanto", "assegnati", "non visualizza", "non ha accesso"]
SERVICE_HINTS = ["procedura guidata", "assistenza", "supporto", "contattare", "numero verde"]
MANDATORY_RULE = "È obbligatorio inserire un indirizzo email valido per completare la richiesta, poiché le comunicazioni e le conferme vengono inviate tramite email."
ACCESS_RULE = "L’utente può visualizzare esclusivamente le risorse assegnate e non ha accesso ad altre informazioni non autorizzate."
SERVICE_RULE = "La procedura guidata fa riferimento a un servizio di assistenza o supporto che accompagna l’utente nelle fasi operative previste."
#: Concepts and what stands for them, for rewritten passages and (CONCEPTS_BUILT) for built ones, less the product's name.
CONCEPTS = [
    ("DASHBOARD", ["cruscotto", "dashboard", "cruscotto di sintesi", "cruscotto sqnba", "sqnba", "cruscotto verifica prerequisiti", "cruscotto prerequisiti"]),
    ("ASSISTENZA_TELEFONICA", ["procedura guidata", "assistenza telefonica", "numero di assistenza", "call center", "supporto telefonico", "numero verde", "assistenza", "supporto"]),
    ("INVIO_EMAIL", ["inviare la richiesta", "invio documentazione", "spedire la richiesta", "mandare la domanda", "inviare via email", "invio via email"]),
    ("ACRONIMI_DOMAIN", ["OdC", "BDN", "ASL", "IZS", "CL", "FAQ", "DDDAit", "DPA", "SQNBA", "PAC", "PEC", "PIN", "APP"]),
]
CONCEPTS_BUILT = [
    ("DASHBOARD", ["cruscotto", "dashboard", "pannello", "schermata principale"]),
    ("REGISTRAZIONE", ["registrazione", "registrare", "registrarsi", "iscrizione"]),
    ("ACCESSO", ["accesso", "login", "accedere", "autenticazione", "spid", "cie"]),
    ("DELEGA", ["delega", "delegato", "delegare", "sostituzione"]),
    ("CHECKLIST", ["checklist", "check-list", "check list", "lista di controllo"]),
    ("BENESSERE_ANIMALE", ["benessere animale", "benessere", "welfare"]),
    ("BIOSICUREZZA", ["biosicurezza", "bio-sicurezza", "biocheck"]),
    ("FARMACOSORVEGLIANZA", ["farmacosorveglianza", "farmaco", "antimicrobico", "antibiotico"]),
    ("VETERINARIO", ["veterinario", "veterinari", "medico veterinario"]),
    ("OPERATORE", ["operatore", "allevatore", "operatori"]),
    ("BDN", ["bdn", "banca dati nazionale"]),
    ("SQNBA", ["sqnba", "sistema qualita'", "sistema qualità", "qualita' nazionale"]),
    ("OdC", ["odc", "organismo di certificazione", "organismo certificazione"]),
    ("ASL", ["asl", "azienda sanitaria", "servizio veterinario"]),
    ("PIANO_RIENTRO", ["piano di rientro", "piano rientro", "pdr"]),
    ("QUESTIONARI", ["questionari", "questionario", "sistema questionari"]),
]
#: Acronyms and their meanings.
ACRONYMS = {
    "OdC": ["organismo di certificazione", "organismo certificazione", "ente certificazione"],
    "BDN": ["banca dati nazionale", "base dati nazionale"],
    "ASL": ["azienda sanitaria locale", "servizio veterinario"],
    "IZS": ["istituto zooprofilattico"],
    "CL": ["checklist", "check-list", "lista controllo", "scheda valutazione"],
    "FAQ": ["domande frequenti", "frequently asked questions"],
    "DDDAit": ["defined daily dose", "dose giornaliera definita"],
    "DPA": ["destinato produzione alimenti"],
    "SQNBA": ["sistema qualità nazionale benessere animale"],
    "PAC": ["politica agricola comune"],
    "PEC": ["posta elettronica certificata"],
    "PIN": ["codice pin", "password"],
    "APP": ["applicazione", "applicazione mobile"],
}
#: Domain words taken as keywords, less the product's name.
DOMAIN_WORDS = [
    "registrazione", "accesso", "delega", "checklist", "benessere", "biosicurezza", "farmacosorveglianza", "veterinario", "operatore",
    "allevamento", "suini", "bovini", "avicoli", "ovicaprini", "conigli", "questionario", "piano di rientro", "spid", "cie", "bdn", "sqnba", "dashboard",
]
#: Synonyms by which a question is varied.
SYNONYMS = [
    ("odc", ["organismo di certificazione", "ente certificatore"]),
    ("bdn", ["banca dati nazionale", "database nazionale"]),
    ("sqnba", ["sistema qualità nazionale benessere animale"]),
    ("pac", ["politica agricola comune"]),
    ("operatore", ["allevatore", "detentore", "proprietario"]),
    ("delegato", ["rappresentante", "incaricato"]),
    ("veterinario aziendale", ["veterinario di azienda", "vet aziendale"]),
    ("veterinario incaricato", ["veterinario delegato", "vet incaricato"]),
    ("associare", ["collegare", "abbinare", "registrare"]),
    ("compilare", ["riempire", "completare"]),
    ("caricare", ["uploadare", "inviare", "trasmettere"]),
    ("scaricare", ["downloadare", "salvare", "esportare"]),
    ("modificare", ["cambiare", "aggiornare", "editare"]),
    ("cancellare", ["eliminare", "rimuovere", "delete"]),
    ("checklist", ["cl", "check-list", "questionario"]),
    ("cruscotto", ["dashboard", "pannello di controllo"]),
    ("allevamento", ["azienda", "struttura", "impresa"]),
    ("abilitazione", ["autorizzazione", "permesso", "accesso"]),
]
#: Addresses that a crawl leaves out, and a section's first keyword.
EXCLUDED = ["/wp-admin", "/wp-login", "/feed/", r"\?s=", "#", "mailto:", "javascript:", r"facebook\.com", r"twitter\.com", r"linkedin\.com", r"youtube\.com"]
SECTIONS = [
    ("faq", "FAQ"), ("domande-frequenti", "FAQ"), ("guida", "Guide"), ("manuale", "Manuali"), ("documento", "Documentazione"),
    ("normativa", "Normativa"), ("news", "News"), ("aggiornamenti", "Aggiornamenti"), ("download", "Download"), ("moduli", "Moduli"),
]
#: Factors of the deterministic reranking.
PROCEDURAL_ROLES = ["mandatory_rule", "access_rule", "service_mapping", "contact_rule"]
CATEGORY_BOOST = [("master_faq", 5.0), ("faq", 2.5), ("web_faq", 1.8), ("guide_procedural", 1.3), ("access_procedure", 1.2)]
#: Weights of the vector and the lexical list by a question's intent.
WEIGHTS = [("acronym_definition", 0.3, 0.7), ("definitional", 0.6, 0.4), ("procedural", 0.7, 0.3), ("generic", 0.6, 0.4)]
#: Least scores of an evaluated answer.
THRESHOLDS = [("groundedness", 0.85), ("self_contained", 0.70), ("relevance", 0.70), ("consistency", 0.75), ("context_precision", 0.60)]
