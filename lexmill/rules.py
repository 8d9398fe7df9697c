"""Rule vocabularies.

Every job takes its rule tables as parameters; the values here are defaults.
A larger clause vocabulary (any number of categories) is loaded from a JSON
file of the form ``{category: {"keywords": [...], "regex": "..."}}`` with
:func:`load_clause_rules`; order in the file is rule order, and the first
category with the highest score wins.
"""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class RuleError(ValueError):
    """A rule file is missing, empty or lacks a required key."""


class ClauseRule(NamedTuple):
    category: str
    keywords: tuple[str, ...]
    regex: str


# Clause categories with keywords and regex, in rule order.
CLAUSE_RULES: list[ClauseRule] = [
    ClauseRule("Termination",
               ("terminate", "termination", "expiry", "expiration", "material breach", "cure period", "written notice",
                "terminate for convenience", "termination for cause", "notice of termination", "early termination", "wind down",
                "cessation of services"),
               r"\bterminate\b|\btermination\b|\bexpiry\b|\bexpiration\b|\bbreach\b|\bwind[\s-]?down\b|"
               r"\bcease\s+to\s+be\s+effective\b|\bterminat(ing|ed)\b"),
    ClauseRule("Liability",
               ("liability", "limitation of liability", "liable", "cap", "indirect damages", "consequential damages",
                "special damages", "limitation of damages", "aggregate liability", "exclusion of liability", "punitive damages",
                "no event shall"),
               r"\bliab(le|ility)\b|\blimit(ation)?\s+of\s+liability\b|\bconsequential\s+damages\b|"
               r"\bexclu(de|sion)\s+of\s+liability\b|\baggregate\s+liability\b|\bpunitive\s+damages\b"),
    ClauseRule("Confidentiality",
               ("confidential", "confidentiality", "non-disclosure", "nda", "proprietary information", "trade secret",
                "non-disclosure agreement", "confidential disclosure", "protected information", "restricted information"),
               r"\bconfidential(ity)?\b|\bnon-disclosure\b|\bproprietary\b|\bsecrets?\b|\bnon-disclosure\s+agreement\b|"
               r"\brestricted\s+information\b|\bprotected\s+information\b"),
    ClauseRule("Arbitration",
               ("arbitration", "arbitrate", "arbitrator", "aaa", "jams", "binding", "dispute resolution", "icc", "uncitral",
                "mediation", "final and binding", "arbitral tribunal"),
               r"\barbitrat(e|ion|or)\b|\bdispute\s+resolution\b|\bmediation\b|\bfinal\s+and\s+binding\b|\barbitral\s+tribunal\b|"
               r"\bicc\b|\buncitral\b"),
    ClauseRule("Payment",
               ("payment", "invoice", "fee", "price", "billing", "due date", "interest", "reimbursement", "remuneration",
                "consideration", "wire transfer", "net 30", "late payment", "outstanding balance", "invoiced amount"),
               r"\bpay(ment)?s?\b|\binvoic(es?|ing)\b|\bfee(s)?\b|\bbill(ing)?\b|\bremuneration\b|\bconsideration\b|"
               r"\bwire\s+transfer\b|\bnet\s+\d+\b|\boutstanding\s+balance\b"),
    ClauseRule("Indemnity",
               ("indemnify", "indemnity", "indemnification", "hold harmless", "defend", "losses", "claims", "indemnitee",
                "indemnitor", "third-party claim", "hold-harmless", "liabilities arising"),
               r"\bindemni(fy|t|fication)\b|\bhold\s+harmless\b|\bdefend\b|\bindemnit(ee|or)\b|\bthird[\s-]?party\s+claims?\b"),
    ClauseRule("Compliance",
               ("compliance", "comply", "applicable laws", "regulations", "sanctions", "anti-corruption", "fcpa",
                "regulatory requirements", "legal requirements", "governmental authority", "code of conduct", "aml", "kyc",
                "data protection laws"),
               r"\bcompli(ance|y|ied)\b|\bapplicable\s+laws?\b|\bregulations?\b|\bregulatory\s+requirements?\b|"
               r"\bgovernmental\s+authority\b|\bcode\s+of\s+conduct\b|\baml\b|\bkyc\b"),
    ClauseRule("Jurisdiction",
               ("jurisdiction", "governing law", "venue", "forum", "courts of", "governed by", "state of",
                "exclusive jurisdiction", "choice of law", "submit to the jurisdiction", "courts located in"),
               r"\bjurisdiction\b|\bgoverning\s+law\b|\bvenue\b|\bforum\b|\bchoice\s+of\s+law\b|\bexclusive\s+jurisdiction\b|"
               r"\bsubmit\s+to\s+the\s+jurisdiction\b"),
    ClauseRule("Force Majeure",
               ("force majeure", "act of god", "natural disaster", "unforeseeable", "war", "strike", "riot", "fire", "pandemic",
                "epidemic", "government action", "beyond reasonable control", "acts of terrorism"),
               r"\bforce\s+majeure\b|\bact\s+of\s+god\b|\bunforeseeable\b|\bpandemic\b|\bepidemic\b|"
               r"\bbeyond\s+(its\s+|their\s+|the\s+)?reasonable\s+control\b|\bacts?\s+of\s+terrorism\b"),
    ClauseRule("Assignment",
               ("assign", "assignment", "assignable", "transfer of rights", "delegate", "successors and assigns", "novation"),
               r"\bassign(s|ed|ment|able)?\b|\bnovation\b|\bsuccessors\s+and\s+assigns\b|\bdelegat(e|ion)\b"),
    ClauseRule("Amendment",
               ("amendment", "amend", "modification", "modify", "written consent of both parties", "supplement", "revise"),
               r"\bamend(ment|ed|s)?\b|\bmodif(y|ication|ied)\b|\bsupplement(al)?\b"),
    ClauseRule("Entire Agreement",
               ("entire agreement", "integration clause", "supersedes", "entire understanding", "whole agreement", "merger clause"),
               r"\bentire\s+agreement\b|\bintegration\s+clause\b|\bsupersede(s)?\b|\bwhole\s+agreement\b|\bmerger\s+clause\b"),
    ClauseRule("Severability",
               ("severability", "severable", "unenforceable provision", "invalid provision", "remainder shall remain"),
               r"\bsever(ability|able)\b|\bunenforceable\b|\binvalid\s+or\s+unenforceable\b|\bremain(der|ing)\s+provisions?\b"),
    ClauseRule("Notices",
               ("notice", "notices", "notify", "written notice", "delivered by hand", "registered mail", "certified mail",
                "email notice"),
               r"\bnotices?\b|\bnotify\b|\bregistered\s+mail\b|\bcertified\s+mail\b|\bdeliver(ed|y)\s+(by|to)\b"),
    ClauseRule("Waiver",
               ("waiver", "waive", "no waiver", "failure to enforce", "waived right"),
               r"\bwaiv(er|e|ed)\b|\bfailure\s+to\s+enforce\b|\bno\s+waiver\b"),
    ClauseRule("Representations and Warranties",
               ("represents and warrants", "representation", "warranty", "warrants that", "each party represents"),
               r"\brepresent(s|ation)?\s+and\s+warrant(s|y|ies)?\b|\brepresents\s+and\s+warrants\b|\bwarrants?\s+that\b"),
    ClauseRule("Warranty Disclaimer",
               ("as is", "disclaims all warranties", "no warranty", "without warranty", "merchantability",
                "fitness for a particular purpose"),
               r"\bdisclaims?\s+(all\s+)?warrant(y|ies)\b|\bas[\s-]is\b|\bmerchantability\b|"
               r"\bfitness\s+for\s+a\s+particular\s+purpose\b"),
    ClauseRule("Intellectual Property",
               ("intellectual property", "copyright", "trademark", "patent", "trade secret", "ip rights", "work product",
                "license grant"),
               r"\bintellectual\s+property\b|\bcopyright(s)?\b|\btrademark(s)?\b|\bpatent(s)?\b|\bwork\s+product\b|"
               r"\blicense\s+grant\b"),
    ClauseRule("Restrictive Covenants",
               ("non-compete", "non-competition", "non-solicitation", "non-circumvention", "restrictive covenant",
                "competing business", "solicit employees"),
               r"\bnon[\s-]?compet(e|ition)\b|\bnon[\s-]?solicit(ation)?\b|\bnon[\s-]?circumvent(ion)?\b|"
               r"\brestrictive\s+covenant\b"),
    ClauseRule("Data Protection",
               ("data protection", "personal data", "privacy policy", "gdpr", "data processing", "data subject", "data breach",
                "medical information", "medical records", "health information", "health records"),
               r"\bdata\s+protection\b|\bpersonal\s+data\b|\bprivacy\s+polic(y|ies)\b|\bgdpr\b|\bdata\s+process(ing|or)\b|"
               r"\bdata\s+breach\b|\bmedical\s+(information|records)\b|\bhealth\s+(information|records)\b"),
    ClauseRule("Insurance Requirements",
               ("maintain insurance", "insurance coverage", "certificate of insurance", "additional insured",
                "general liability insurance", "workers compensation insurance"),
               r"\bmaintain\s+insurance\b|\bcertificate\s+of\s+insurance\b|\badditional\s+insured\b|"
               r"\bworkers[\s']?\s+compensation\b|\bgeneral\s+liability\s+insurance\b"),
    ClauseRule("Independent Contractor",
               ("independent contractor", "not an employee", "no employer-employee relationship", "self-employed"),
               r"\bindependent\s+contractor\b|\bnot\s+an\s+employee\b|\bemployer[\s-]employee\s+relationship\b"),
    ClauseRule("Counterparts",
               ("counterparts", "executed in counterparts", "duplicate originals", "facsimile signature", "electronic signature",
                "in witness whereof", "witness", "executed by", "execution", "signature block"),
               r"\bcounterparts?\b|\bduplicate\s+originals?\b|\belectronic\s+signature\b|\bfacsimile\s+signature\b|"
               r"\bin\s+witness\s+whereof\b|\bwitness(es)?\b|\bexecuted\s+by\b|\bexecution\b|\bsignature\s+block\b"),
    ClauseRule("Survival",
               ("survival", "survive termination", "survive expiration", "shall survive"),
               r"\bsurviv(al|e|es|ed)\b|\bshall\s+survive\b"),
    ClauseRule("Third-Party Beneficiaries",
               ("third-party beneficiary", "no third party rights", "no third-party beneficiaries"),
               r"\bthird[\s-]?party\s+benefici(ary|aries)\b|\bno\s+third[\s-]?party\s+rights\b"),
    ClauseRule("Audit Rights",
               ("audit", "right to audit", "inspect records", "books and records", "audit rights"),
               r"\baudit(s|ing)?\b|\bright\s+to\s+audit\b|\binspect\s+records\b|\bbooks\s+and\s+records\b"),
    ClauseRule("Coverage and Scope",
               ("coverage", "covered loss", "scope of coverage", "insured event", "sum insured", "policy limits",
                "insuring clause", "covers", "covered by", "driver eligibility", "authorized driver", "permitted use",
                "limitations as to use"),
               r"\bcoverage\b|\bcovered\s+(loss|event|peril|by)\b|\bcovers?\b|\bsum\s+insured\b|\bpolicy\s+limits?\b|"
               r"\binsuring\s+clause\b|\bdriver\s+eligibility\b|\bauthorized\s+driver(s)?\b|\bpermitted\s+use\b|"
               r"\blimitations?\s+as\s+to\s+use\b"),
    ClauseRule("Premium",
               ("premium", "premium payment", "premium due", "grace period", "premium amount"),
               r"\bpremium(s)?\b|\bgrace\s+period\b"),
    ClauseRule("Deductible and Exclusions",
               ("deductible", "exclusion", "excluded loss", "not covered", "policy exclusions"),
               r"\bdeductible(s)?\b|\bexclu(sion|ded)s?\b|\bnot\s+covered\b"),
    ClauseRule("Claims Procedure",
               ("claim", "claims procedure", "notice of claim", "proof of loss", "file a claim", "claims adjuster"),
               r"\bclaims?\b|\bproof\s+of\s+loss\b|\bclaims?\s+adjuster\b|\bfile\s+a\s+claim\b"),
    ClauseRule("Beneficiary Designation",
               ("beneficiary", "named beneficiary", "beneficiary designation", "policyholder", "insured party"),
               r"\bbenefici(ary|aries)\b|\bpolicyholder\b|\binsured\s+part(y|ies)\b"),
    ClauseRule("Policy Period and Renewal",
               ("policy period", "effective date", "renewal", "policy term", "expiration date of the policy"),
               r"\bpolicy\s+(period|term)\b|\brenewal\b|\beffective\s+date\b"),
    ClauseRule("Cancellation",
               ("cancellation", "cancel the policy", "right to cancel", "cancellation notice", "non-renewal", "void",
                "void ab initio", "null and void"),
               r"\bcancel(lation|led|s)?\b|\bnon[\s-]?renewal\b|\bvoid\b|\bvoid\s+ab\s+initio\b|\bnull\s+and\s+void\b"),
    ClauseRule("Subrogation",
               ("subrogation", "subrogate", "right of subrogation", "waiver of subrogation"),
               r"\bsubrogat(ion|e)\b"),
    ClauseRule("Compensation and Benefits",
               ("salary", "wages", "compensation", "bonus", "benefits", "base pay", "annual salary", "employee benefits"),
               r"\bsalary\b|\bwages\b|\bcompensation\b|\bbonus(es)?\b|\bbase\s+pay\b|\bemployee\s+benefits\b"),
    ClauseRule("Rent and Lease Payments",
               ("rent", "monthly rent", "rental payment", "lease payment", "rent due"),
               r"\brent(al)?\b|\blease\s+payment\b|\brent\s+due\b"),
    ClauseRule("Security Deposit",
               ("security deposit", "deposit refund", "damage deposit", "return of deposit"),
               r"\bsecurity\s+deposit\b|\bdamage\s+deposit\b|\breturn\s+of\s+(the\s+)?deposit\b"),
    ClauseRule("Maintenance and Repairs",
               ("maintenance", "repairs", "upkeep", "landlord shall maintain", "tenant shall maintain", "condition of premises"),
               r"\bmaintenance\b|\brepairs?\b|\bupkeep\b|\bcondition\s+of\s+(the\s+)?premises\b"),
    ClauseRule("Delivery and Risk of Loss",
               ("delivery", "risk of loss", "shipping terms", "fob", "title passes", "delivery date"),
               r"\bdelivery\b|\brisk\s+of\s+loss\b|\bshipping\s+terms\b|\bfob\b|\btitle\s+passes\b"),
    ClauseRule("Inspection and Acceptance",
               ("inspection", "acceptance", "reject the goods", "acceptance testing", "inspect and accept"),
               r"\binspection\b|\bacceptance\b|\breject(ed|ion)?\s+(the\s+)?goods\b|\bacceptance\s+testing\b"),
    ClauseRule("Interest and Fees",
               ("interest rate", "annual percentage rate", "apr", "late fee", "penalty interest", "default interest"),
               r"\binterest\s+rate\b|\bannual\s+percentage\s+rate\b|\bapr\b|\bdefault\s+interest\b|\blate\s+fee\b"),
    ClauseRule("Collateral and Security Interest",
               ("collateral", "security interest", "lien", "pledge", "secured party", "encumbrance"),
               r"\bcollateral\b|\bsecurity\s+interest\b|\blien(s)?\b|\bpledge(d)?\b|\bencumbrance(s)?\b"),
    ClauseRule("Covenants",
               ("affirmative covenant", "negative covenant", "financial covenant", "covenant to", "borrower shall"),
               r"\bcovenant(s)?\b|\baffirmative\s+covenant\b|\bnegative\s+covenant\b|\bfinancial\s+covenant\b"),
    ClauseRule("Events of Default",
               ("event of default", "default", "acceleration", "cross-default", "cure period", "remedies upon default"),
               r"\bevent(s)?\s+of\s+default\b|\bdefault(ed|s)?\b|\bacceleration\b|\bcross[\s-]?default\b"),
    ClauseRule("Capital Contribution",
               ("capital contribution", "contribute capital", "initial contribution", "additional contribution", "capital account"),
               r"\bcapital\s+contribution(s)?\b|\bcapital\s+account\b"),
    ClauseRule("Profit and Loss Allocation",
               ("profit and loss", "profits and losses", "distribution of profits", "allocation of profits", "share of profits",
                "loss allocation"),
               r"\bprofit(s)?\s+and\s+loss(es)?\b|\ballocation\s+of\s+profits?\b|\bdistribution\s+of\s+profits?\b"),
    ClauseRule("Dissolution and Withdrawal",
               ("dissolution", "withdrawal of a partner", "winding up", "dissolve the partnership", "exit of a partner"),
               r"\bdissolution\b|\bdissolve(d)?\b|\bwinding\s+up\b|\bwithdrawal\s+of\s+(a\s+)?partner\b"),
    ClauseRule("Relationship of Parties",
               ("relationship of the parties", "independent parties", "no partnership", "no joint venture", "no agency"),
               r"\brelationship\s+of\s+the\s+parties\b|\bno\s+(partnership|joint\s+venture|agency)\s+is\s+created\b|"
               r"\bindependent\s+parties\b"),
    ClauseRule("Dispute Resolution",
               ("dispute resolution", "mediation", "litigation", "negotiate in good faith", "escalation procedure",
                "resolve disputes"),
               r"\bdispute\s+resolution\b|\bmediation\b|\blitigation\b|\bnegotiate\s+in\s+good\s+faith\b|\bresolve\s+disputes?\b"),
    ClauseRule("Recitals and Background",
               ("borrower", "lender", "employer", "employee", "party identification", "registered office", "registered address",
                "residing at", "purpose of agreement", "this agreement is made", "whereas", "recitals", "background"),
               r"\bwhereas\b|\brecitals\b|\bbackground\b|\bthis\s+agreement\s+is\s+made\b|"
               r"\bpurpose\s+of\s+(this\s+|the\s+)?agreement\b|\bregistered\s+(office|address)\b|\bresiding\s+at\b"),
    ClauseRule("Term and Duration",
               ("term of agreement", "duration", "effective period", "shall continue", "months", "years", "commencement",
                "agreement period"),
               r"\bterm\s+of\s+(this\s+|the\s+)?agreement\b|\bagreement\s+period\b|\beffective\s+period\b|\bshall\s+continue\b|"
               r"\bcommenc(e|ement|ing)\b|\bduration\b"),
    ClauseRule("Workplace Monitoring and Surveillance",
               ("surveillance", "monitoring", "camera", "cctv", "microphone", "tracking device", "gps tracking",
                "employee monitoring", "remote monitoring", "workplace monitoring"),
               r"\bsurveillance\b|\bmonitor(ing)?\b|\bcamera(s)?\b|\bcctv\b|\bmicrophone(s)?\b|\btracking\s+device(s)?\b|"
               r"\bgps\s+tracking\b|\bemployee\s+monitoring\b|\bremote\s+monitoring\b|\bworkplace\s+monitoring\b"),
    ClauseRule("Leave and Time Off",
               ("annual leave", "sick leave", "emergency leave", "paid leave", "vacation", "pto", "time off", "leave policy"),
               r"\bannual\s+leave\b|\bsick\s+leave\b|\bemergency\s+leave\b|\bpaid\s+leave\b|\bvacation\b|\bpto\b|\btime\s+off\b|"
               r"\bleave\s+polic(y|ies)\b"),
]

# Importance tiers and their base scores.
CRITICAL_TYPES = ["Liability", "Indemnity", "Termination", "Jurisdiction"]
IMPORTANT_TYPES = ["Payment", "Confidentiality", "Compliance"]
TIER_SCORES = {"critical": 80, "important": 55, "informational": 30}

# Words that mark boilerplate headings, uncapped exposure and penalties.
BOILERPLATE_WORDS = ["preamble", "notice", "signature", "contact", "recital", "witnesseth"]
UNLIMITED_WORDS = ["uncapped", "unlimited"]
PENALTY_WORDS = ["penalty", "liquidated damages"]
REGULATION_WORDS = ["regulation", "statute", "sanction", "fcpa", "compliance"]
BUSINESS_WORDS = ["sla", "deliverable", "milestone", "service level"]
IMPACT_ESCALATORS = ["penalty", "liquidated damages", "unlimited", "uncapped"]

# Impact baselines (legal, financial, business, compliance).
IMPACT_BASE = {
    "Termination": (60, 40, 50, 20),
    "Liability": (70, 75, 40, 30),
    "Confidentiality": (40, 20, 30, 50),
    "Arbitration": (55, 25, 20, 15),
    "Payment": (30, 70, 50, 20),
    "Indemnity": (75, 70, 35, 30),
    "Compliance": (50, 30, 30, 75),
    "Jurisdiction": (55, 15, 15, 25),
    "Force Majeure": (35, 30, 55, 20),
    "General": (10, 10, 10, 10),
}

# Dependencies between clause types (source, target, relation).
DEPENDENCIES = [
    ("Termination", "Liability", "triggers"),
    ("Termination", "Indemnity", "triggers"),
    ("Payment", "Compliance", "subject_to"),
    ("Payment", "Force Majeure", "suspended_by"),
    ("Indemnity", "Liability", "limits"),
    ("Confidentiality", "Arbitration", "enforced_via"),
    ("Compliance", "Jurisdiction", "governed_by"),
]

# Escalating and mitigating phrases.
ESCALATORS = ["uncapped", "unlimited", "without limitation", "sole discretion", "irrevocable", "penalty",
              "liquidated damages", "immediate termination", "forfeit"]
MITIGATORS = ["cap of", "capped at", "limited to", "mutual", "reasonable efforts", "commercially reasonable",
              "best efforts", "cure period", "written notice"]

# Title subtopics per category (trigger phrases, title), in order.
TITLE_SUBTOPICS = {
    "Confidentiality": [
        (("means any information", "confidential information means", "definition of confidential"),
         "Definition of Confidential Information"),
        (("shall not disclose", "not disclose", "non-disclosure", "obligation of confidentiality"),
         "Non-Disclosure Obligations"),
        (("permitted to disclose", "may disclose", "required by law", "compelled by law",
          "required by applicable law"), "Permitted Disclosure"),
        (("return or destroy", "return all", "destroy all", "return of confidential", "return of all"),
         "Return of Confidential Information"),
        (("survive termination", "years after", "period of confidentiality", "remain in effect",
          "shall survive"), "Confidentiality Period"),
        (("does not include", "shall not apply", "exceptions", "excludes information",
          "not include information"), "Exceptions to Confidentiality"),
    ],
    "Termination": [
        (("for convenience",), "Termination for Convenience"),
        (("material breach", "for cause", "cure period"), "Termination for Cause"),
        (("written notice", "notice period", "days notice", "days' notice"), "Termination Notice Requirements"),
        (("effect of termination", "upon termination", "survive termination"), "Effects of Termination"),
    ],
    "Liability": [
        (("cap on liability", "limitation of liability", "limited to", "capped at", "no event"),
         "Limitation of Liability"),
        (("consequential damages", "indirect damages", "special damages", "punitive damages"),
         "Exclusion of Consequential Damages"),
        (("joint and several",), "Joint and Several Liability"),
    ],
    "Payment": [
        (("late fee", "penalty", "acceleration"), "Late Payment Penalties"),
        (("interest",), "Interest on Outstanding Amounts"),
        (("invoice", "invoicing"), "Invoicing Terms"),
        (("due date", "due within", "net 30", "immediate payment"), "Payment Due Date"),
        (("non-refundable",), "Non-Refundable Payments"),
    ],
    "Indemnity": [
        (("hold harmless",), "Indemnification and Hold Harmless"),
        (("third-party claims", "third party claims"), "Third-Party Claims Indemnity"),
        (("sole negligence", "gross negligence"), "Indemnity for Negligence"),
        (("unlimited indemnification",), "Scope of Indemnification"),
    ],
    "Compliance": [
        (("anti-corruption", "fcpa"), "Anti-Corruption Compliance"),
        (("sanctions",), "Sanctions Compliance"),
        (("applicable laws", "regulations"), "Regulatory Compliance"),
    ],
    "Jurisdiction": [
        (("governing law",), "Governing Law"),
        (("venue", "forum"), "Venue and Forum Selection"),
        (("jurisdiction",), "Governing Law and Jurisdiction"),
    ],
    "Force Majeure": [
        (("act of god", "natural disaster"), "Force Majeure Events"),
        (("unforeseeable",), "Unforeseeable Events (Force Majeure)"),
    ],
    "Arbitration": [
        (("binding arbitration", "binding"), "Binding Arbitration"),
        (("aaa", "jams"), "Arbitration Rules and Administration"),
        (("dispute resolution",), "Dispute Resolution"),
    ],
}

# Titles used when no subtopic phrase occurs.
FALLBACK_TITLES = {
    "Termination": "Termination Rights",
    "Liability": "Liability Provisions",
    "Confidentiality": "Confidentiality Obligations",
    "Arbitration": "Dispute Resolution via Arbitration",
    "Payment": "Payment Terms",
    "Indemnity": "Indemnification Obligations",
    "Compliance": "Regulatory Compliance",
    "Jurisdiction": "Governing Law and Jurisdiction",
    "Force Majeure": "Force Majeure Events",
}

# Words skipped when a title is made from the first sentence.
TITLE_STOPWORDS = ("the a an and or but if then shall must will may not of to in on at by with "
                   "for from this that these those as is are be been being which who whom whose").split()

# Lower-case words allowed inside a title-case heading.
HEADING_CONNECTORS = ["of", "and", "the", "in", "for", "to", "on", "by", "with", "or",
                      "a", "an", "as", "under", "per", "at", "from"]

# Modal classes, action lexicon, action and entity classes.
STRONG_MODALS = ["shall", "must", "will"]
WEAK_MODALS = ["may", "might", "could", "should"]
ACTION_PHRASES = [("hold harmless", "indemnification"), ("limitation of liability", "limitation_of_liability")]
ACTION_WORDS = [
    ("terminate", "termination"), ("termination", "termination"),
    ("indemnify", "indemnification"), ("indemnification", "indemnification"), ("indemnity", "indemnification"),
    ("waive", "waiver"), ("waiver", "waiver"),
    ("assign", "assignment"), ("assignment", "assignment"),
    ("comply", "compliance"), ("compliance", "compliance"), ("compliant", "compliance"),
    ("sanction", "sanctions"), ("sanctions", "sanctions"),
]
LEGAL_ACTIONS = ["termination", "indemnification", "waiver", "assignment", "limitation_of_liability"]
COMPLIANCE_ACTIONS = ["compliance", "regulatory_filing", "sanctions", "anti_corruption"]
REGULATORY_ENTITIES = ["LAW", "ORG_REGULATOR", "STATUTE", "GPE"]

# Verbs that mark a clause as prose (stands in for a part-of-speech tagger).
PROSE_VERBS = ["is", "are", "was", "were", "be", "been", "being", "has", "have", "had", "do", "does", "did",
               "shall", "must", "will", "may", "might", "could", "should", "can", "would", "agrees", "agree",
               "applies", "means", "terminate", "indemnify", "pay", "provide", "remain", "require", "requires"]

# Keyword gates and labels of the contradiction detectors.
TEMPORAL_WORDS = ["effective date", "notice period", "cure period", "term of this agreement", "renewal"]
PAYMENT_WORDS = ["late fee", "interest", "penalty", "due within", "payment terms"]
JURISDICTION_WORDS = ["governing law", "governed by", "jurisdiction", "venue", "courts of", "laws of", "state of"]
CAP_WORDS = ["cap", "capped", "limited to", "maximum of", "not to exceed"]
UNCAP_WORDS = ["uncapped", "unlimited", "without limit", "no limitation"]
SEVERITY_RANK = {"High": 3, "Medium": 2, "Low": 1, "None": 0}

# Days per duration unit and currency prefixes, in match order.
DAYS_PER_UNIT = {"day": 1, "days": 1, "week": 7, "weeks": 7, "month": 30, "months": 30, "year": 365, "years": 365}
CURRENCY_PREFIXES = [("US$", "USD"), ("USD", "USD"), ("$", "USD"), ("₹", "INR"), ("INR", "INR"),
                     ("Rs.", "INR"), ("Rs", "INR"), ("€", "EUR"), ("£", "GBP")]
SCALE_WORDS = [("thousand", 1e3), ("lakh", 1e5), ("crore", 1e7), ("million", 1e6), ("billion", 1e9)]

# Risk dimensions, cuts and fallback points.
DIMENSIONS = ["Financial", "Legal", "Compliance", "Operational", "Ambiguity"]
PROTOTYPE_DIMENSIONS = ["Financial", "Legal", "Compliance", "Operational"]
CLAUSE_CUTS = (35.0, 70.0)
DOCUMENT_CUTS = (35.0, 60.0, 80.0)
LEVEL_POINTS = {"High": 90, "Medium": 55, "Low": 25, "None": 5}
MIN_REFERENCE = 30

# Recommendations per clause type.
RECOMMENDATIONS = {
    "Liability": "Negotiate a liability cap and carve out indirect/consequential damages.",
    "Indemnity": "Narrow the indemnification scope and add a mutual indemnity provision if one-sided.",
    "Termination": "Add a cure period and require written notice before termination takes effect.",
    "Payment": "Clarify payment timelines, late-fee interest rates, and dispute procedures.",
    "Confidentiality": "Confirm confidentiality survives termination and define a reasonable duration.",
    "Compliance": "Verify the compliance obligations map to your actual regulatory footprint.",
    "Jurisdiction": "Confirm the governing law/venue is acceptable and not unduly burdensome.",
    "Force Majeure": "Ensure force majeure events are clearly enumerated and notice periods are workable.",
    "Arbitration": "Confirm arbitration rules/seat are balanced and not overly costly for either party.",
}
NO_RECOMMENDATION = ("No specific high-risk clause types identified; "
                     "review the document for general legal soundness.")

# One line of context per risk dimension.
DIMENSION_CONTEXT = {
    "Financial": "This clause carries financial risk — it can directly affect what you pay, owe, or recover "
                 "if something goes wrong.",
    "Legal": "This clause carries legal risk — it can affect your legal standing, obligations, or ability to "
             "enforce your rights.",
    "Compliance": "This clause carries compliance risk — failing to meet its requirements could expose you to "
                  "regulatory or contractual consequences.",
    "Operational": "This clause carries operational risk — it can disrupt how the agreement is carried out in "
                   "practice.",
    "Ambiguity": "This clause carries ambiguity risk — vague or hedged language makes its obligations harder "
                 "to predict or enforce.",
}

# Prototype sentences per dimension.
PROTOTYPES = {
    "Financial": [
        "This clause creates unlimited or uncapped financial exposure for a party.",
        "This clause imposes a significant monetary penalty or liquidated damages.",
        "This clause requires immediate or accelerated payment obligations."],
    "Legal": [
        "This clause imposes broad or one-sided indemnification obligations.",
        "This clause allows termination without cause or without notice.",
        "This clause requires a party to waive significant legal rights."],
    "Compliance": [
        "This clause imposes regulatory or statutory compliance obligations.",
        "This clause is governed by a specific jurisdiction's laws and courts.",
        "This clause requires adherence to sanctions or anti-corruption regulations."],
    "Operational": [
        "This clause imposes tight deadlines or short notice periods.",
        "This clause creates dependencies on multiple other obligations or milestones.",
        "This clause requires ongoing service level or delivery commitments."],
}

# Authenticity factors, tier cuts and labels.
FACTORS = ["structure", "clause_completeness", "cross_field", "entity_verification", "digital_verification",
           "metadata_validation", "semantic_consistency", "document_type_validator"]
TIER_CUTS = (40.0, 65.0, 80.0, 90.0, 95.0)
TIER_LABELS = ["Likely Manipulated or Forged", "Suspicious", "Mostly Authentic", "Likely Authentic",
               "Strongly Authentic", "Highly Authentic"]

# Mandatory clause types per document type.
MANDATORY_CLAUSES = {
    "Loan Agreement": ["Payment", "Liability", "Jurisdiction", "Termination"],
    "Non-Disclosure Agreement (NDA)": ["Confidentiality", "Termination", "Jurisdiction"],
    "Employment Agreement": ["Payment", "Termination", "Confidentiality", "Compliance"],
    "Lease Agreement": ["Payment", "Termination", "Jurisdiction"],
    "Service Agreement": ["Payment", "Liability", "Termination", "Jurisdiction"],
}

# Fields compared across a document (type, field, pattern, kind).
CROSS_FIELDS = [
    ("Insurance Policy", "Policy Number",
     r"(?<!previous\s)(?<!previous)policy\s*(?:no\.?|number)\s*[:\-]?\s*(?-i:([A-Z0-9][A-Z0-9\-/]{3,}))", "id"),
    ("Insurance Policy", "Sum Assured", r"sum assured[^\d]{0,45}([\d,]+(?:\.\d+)?)", "money"),
    ("Loan Agreement", "Principal Amount", r"principal amount[^\d]{0,45}([\d,]+(?:\.\d+)?)", "money"),
    ("Lease Agreement", "Monthly Rent", r"monthly rent[^\d]{0,45}([\d,]+(?:\.\d+)?)", "money"),
    ("Employment Agreement", "Salary", r"salary[^\d]{0,45}([\d,]+(?:\.\d+)?)", "money"),
    ("Service Agreement", "Fees", r"fees?[^\d]{0,45}([\d,]+(?:\.\d+)?)", "money"),
]

# Weight of each insurance evidence check.
CHECK_WEIGHTS = {"issuer_name": 8, "policy_number": 10, "policy_dates": 8, "premium_values": 8,
                 "gst_arithmetic": 12, "customer_identity_consistency": 10, "vehicle_identifiers": 6,
                 "receipt_information": 6, "qr_presence": 5, "digital_signature_presence": 5,
                 "irdai_registration": 10, "cross_page_consistency": 12}

# Question phrases per metric, in match order.
METRIC_PHRASES = [
    ("risky_clause_count", ("risky clause", "risky clauses", "flagged clause", "flagged clauses",
                            "high risk clause", "high-risk clause", "medium risk clause",
                            "how many clauses are risky", "how many risky")),
    ("authenticity_score", ("authenticity score", "authenticity level", "authenticity confidence",
                            "how authentic", "is this document authentic", "document authenticity")),
    ("document_risk_score", ("document risk score", "overall risk score", "risk score of the document",
                             "risk score of this document", "what is the document's risk score")),
    ("contradiction_count", ("how many contradictions", "contradiction count", "number of contradictions",
                             "how many conflicts", "internal conflicts")),
    ("entity_count", ("how many entities", "entity count", "number of entities", "named entities")),
    ("relationship_count", ("how many relationships", "relationship count", "number of relationships")),
    ("document_type", ("document type", "what type of document", "what kind of document",
                       "type of contract is this", "what kind of contract")),
    ("processing_status", ("processing status", "has this document been processed",
                           "is this document processed", "document status")),
    ("clause_count", ("how many clauses", "clause count", "number of clauses", "total clauses",
                      "total number of clauses")),
]

# Function words per language, for the stop-word language profile.
LANGUAGE_PROFILES = {
    "en": ["the", "and", "of", "to", "is", "that", "with", "was", "for", "are"],
    "fr": ["le", "les", "des", "et", "une", "dans", "est", "pour", "que", "du"],
    "de": ["und", "der", "das", "die", "ist", "nicht", "mit", "ein", "den", "auf"],
    "es": ["el", "los", "las", "y", "una", "por", "del", "con", "para", "es"],
}

# Phrases whose presence is highlighted, and plain-English swaps.
HIGHLIGHT_WORDS = [
    "vague", "unclear", "ambiguous", "ambiguity", "undefined", "missing",
    "unlimited", "uncapped", "penalt", "indemnif", "liability",
    "sole discretion", "unilateral", "without notice", "non-compliant",
    "breach", "dispute", "terminate", "termination",
    "one-sided", "no upper limit", "no limit", "not clearly stated", "lack of clarity",
]
PLAIN_ENGLISH = {
    "indemnification": "compensation for losses",
    "indemnify": "compensate for losses",
    "indemnity": "compensation for losses",
    "unilaterally": "one-sided",
    "unilateral": "one-sided",
    "sole discretion": "its own judgment, without asking you",
    "ambiguous": "unclear",
    "ambiguity": "lack of clarity",
    "undefined": "not clearly stated",
    "liquidated damages": "a pre-agreed penalty amount",
    "governing law": "which state's or country's laws apply",
    "jurisdiction": "which court has authority",
    "force majeure": "unforeseeable events beyond anyone's control",
    "cure period": "time allowed to fix the problem",
    "statutory": "required by law",
    "non-compliant": "not following the rules",
    "unlimited liability": "no limit on what you could owe",
    "uncapped": "with no upper limit",
    "notwithstanding": "despite",
    "herein": "in this document",
    "thereof": "of it",
}


#: A rule file may hold so many bytes; it enters plans as literals.
RULE_BYTES = 4_000_000


def load_clause_rules(spark: SparkSession, path: str) -> list[ClauseRule]:
    """Read and check a clause rule file (category -> keywords, regex) where Spark reads files; order in the file is rule order."""
    found = spark.read.format("binaryFile").load(path).select("length", F.when(F.col("length") <= RULE_BYTES, F.col("content")).alias("content")).head(2)
    if len(found) != 1:
        raise RuleError(f"{path} is not one file")
    if found[0]["content"] is None:
        raise RuleError(f"{path} holds {found[0]['length']} bytes, more than {RULE_BYTES}")
    try:
        raw = json.loads(bytes(found[0]["content"]))
    except ValueError as exc:
        raise RuleError(f"cannot read rule file {path}: {exc}") from exc
    if not raw:
        raise RuleError(f"{path} holds no rules")
    for category, body in raw.items():
        for key in ("keywords", "regex"):
            if not body.get(key):
                raise RuleError(f"{path}: '{category}' lacks a non-empty '{key}'")
    return [ClauseRule(category, tuple(body["keywords"]), body["regex"]) for category, body in raw.items()]


def save_clause_rules(spark: SparkSession, rules: list[ClauseRule], path: str) -> None:
    """Write rules as one rule file below path."""
    text = json.dumps({r.category: {"keywords": list(r.keywords), "regex": r.regex} for r in rules}, ensure_ascii=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def keyword_table(spark: SparkSession, rules: list[ClauseRule] | None = None) -> DataFrame:
    """(rule_ordinal, category, kw_ordinal, keyword): size fixed by the rule file."""
    rows = [(i, r.category, j, k) for i, r in enumerate(rules or CLAUSE_RULES)
            for j, k in enumerate(r.keywords)]
    return spark.createDataFrame(rows, "rule_ordinal int, category string, kw_ordinal int, keyword string")


def values_sql(rows: list[tuple], columns: list[str], alias: str = "t") -> str:
    """A VALUES relation that both engines accept."""
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return repr(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"(SELECT * FROM (VALUES {body}) AS {alias}({', '.join(columns)}))"
