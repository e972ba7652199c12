"""Fixed values of the domain: structure patterns, keywords, queries, vocabularies, defaults."""

from __future__ import annotations

# Structure patterns of each law, coarse to fine: (level, pattern, ignores case). They are matched line by line.
GDPR_PATTERNS = [
    ("chapter", r"^CHAPTER\s+[IVXLCDM]+\b", True),
    ("article", r"^Article\s+\d+\b", True),
    ("clause", r"^\s*\d+\.\s+", False),
]
LGPD_PATTERNS = [
    ("chapter", r"^CAP[IÍ]TULO\s+[IVXLCDM]+\b", True),
    ("article", r"^Art(?:igo)?\.?\s*\d+[oº]?\b", True),
    ("clause", r"^\s*[§§]\s*\d+[oº]?\b|^\s*\d+\.\s+", False),
]
CCPA_PATTERNS = [
    ("section", r"^(?:Section\s+|§\s*)1798\.\d+(?:\.\d+)*\b", True),
    ("clause", r"^\s*\([a-z]\)\s+", False),
]
PIPEDA_PATTERNS = [
    ("schedule", r"^Schedule\s+1\b", True),
    ("principle", r"^(?:Principle\s+\d+\b|4\.(?:1|2|3|4|5|6|7|8|9|10)\s)", True),
    ("clause", r"^\s*4\.\d+\.\d+\s+", False),
]
GENERIC_PATTERNS = [
    ("chapter", r"^(?:CHAPTER|PART|TITLE)\s+[IVXLCDM\d]+\b", True),
    ("article", r"^(?:Article|Section|Art\.?|§)\s*\d+\b", True),
    ("clause", r"^\s*\d+\.\s+|\s*\([a-z]\)\s+", False),
]
LAW_PATTERNS = {"GDPR": GDPR_PATTERNS, "LGPD": LGPD_PATTERNS, "CCPA": CCPA_PATTERNS, "CPRA": CCPA_PATTERNS, "PIPEDA": PIPEDA_PATTERNS}

# Keywords of each concept; laws but PIPEDA share the first table.
KEYWORDS = {
    "LegalBasis": ["lawful", "legal basis", "legal ground", "consent", "contract", "legitimate interest", "legal obligation", "vital interest", "public task", "consentimento", "base legal", "hipótese", "business purpose", "commercial purpose"],
    "ProcessingActivity": ["collect", "store", "use", "share", "transfer", "delete", "process", "processing", "disclose", "handle", "transmit", "colet", "tratar", "tratamento"],
    "RetentionPolicy": ["retention", "storage limitation", "no longer than necessary", "delete", "deletion", "erase", "erasure", "retention period", "as long as necessary", "prazo de conservação", "conservação", "armazenamento"],
    "ConsentWithdrawal": ["withdraw", "withdrawal", "revoke", "revocation", "opt out", "opt-out", "unsubscribe", "as easy as", "as easy to withdraw", "retirar", "revogar"],
    "DataTransfer": ["third country", "international transfer", "cross-border transfer", "adequacy decision", "adequacy", "standard contractual clauses", "binding corporate rules", "bcr", "sccs", "recipient country", "transfer outside", "transferred outside", "transfer to a third country", "transferência internacional", "país terceiro"],
    "Right": ["right to access", "right of access", "right to erasure", "right to be forgotten", "right to rectification", "right to correction", "right to portability", "data portability", "right to object", "right to restriction", "automated decision", "automated processing", "opt-out of sale", "right to know", "right to delete", "direito de acesso", "direito de retificação", "direito à exclusão", "direito de portabilidade"],
    "Purpose": ["purpose", "purposes", "objective", "specific purpose", "processing purpose", "business purpose", "identified purpose", "stated purpose", "finalidade"],
    "PersonalData": ["personal data", "personal information", "sensitive", "special category", "biometric", "health data", "financial data", "location data", "behavioral data", "dados pessoais", "dados sensíveis", "informação pessoal"],
    "Constraint": ["purpose limitation", "data minimisation", "data minimization", "storage limitation", "accuracy", "integrity and confidentiality", "security measure", "technical measure", "organisational measure", "safeguard", "encryption", "pseudonymisation", "reasonable security"],
}
PIPEDA_KEYWORDS = {
    "LegalBasis": ["knowledge and consent", "consent of the individual", "implied consent", "express consent", "meaningful consent", "without the knowledge and consent", "consent is required", "require consent", "without consent", "reasonable person would consider appropriate", "legitimate business purpose", "collected without the knowledge"],
    "ProcessingActivity": ["collection, use", "use, or disclosure", "use or disclosure", "use and disclosure", "collect personal information", "use personal information", "disclose personal information", "disclosed to third parties", "collection of personal information", "handling of personal information", "limiting collection", "limit the collection", "collected by fair and lawful means", "collected for purposes"],
    "RetentionPolicy": ["retain only as long as necessary", "no longer required", "retention of personal information", "retention period", "retention schedule", "destroy", "erase", "render anonymous", "as long as necessary for the fulfilment", "no longer needed", "minimum and maximum retention"],
    "ConsentWithdrawal": ["withdraw consent", "withdrawal of consent", "individual may withdraw", "refuse or withdraw", "notification of the implications of withdrawing", "reasonable notice", "opt out", "consequences of withdrawing"],
    "DataTransfer": ["transfer to a third party", "transfer personal information", "comparable level of protection", "contractual or other means", "transferred outside", "transfer outside canada", "third-party organization", "organization to which the information is transferred", "accountability for transfers"],
    "Right": ["individual access", "access to personal information", "access request", "right of access", "informed of the existence", "existence, use and disclosure", "challenge the accuracy", "correction or amendment", "annotation", "right to challenge", "challenge compliance", "address a complaint", "file a complaint", "privacy commissioner"],
    "Purpose": ["identifying purposes", "purposes for which information is collected", "specified at or before the time of collection", "stated purpose", "identified purpose", "new purpose", "primary purpose", "secondary purpose", "purposes identified", "purpose of the collection", "purpose for collecting"],
    "PersonalData": ["personal information", "sensitive information", "identifiable individual", "about an identifiable individual", "information about an individual", "medical information", "health information", "financial information", "ethnic origin", "racial origin", "religious beliefs", "political opinions", "biometric information"],
    "Constraint": ["accuracy", "as accurate, complete", "update personal information", "security safeguards", "appropriate safeguards", "protect personal information", "unauthorized access", "loss or theft", "unauthorized disclosure", "physical measures", "organizational measures", "technological measures", "limited to that which is necessary", "collected by fair and lawful means", "not collected indiscriminately", "readily available", "make available"],
}
LAW_KEYWORDS = {"PIPEDA": PIPEDA_KEYWORDS}

# The canonical query text of each concept.
CONCEPT_QUERIES = {
    "LegalBasis": "lawful basis legal grounds processing consent contract legitimate interest legal obligation vital interest public task consentimento base legal hipótese",
    "ProcessingActivity": "processing personal data collect store use share transfer delete disclose processing operation treatment dados pessoais tratamento",
    "RetentionPolicy": "retention period storage limitation no longer than necessary delete erase duration keep data prazo conservação armazenamento",
    "ConsentWithdrawal": "withdraw consent revoke opt-out as easy as giving consent unsubscribe retirar consentimento revogar reti",
    "DataTransfer": "transfer third country international adequacy decision standard contractual clauses binding corporate rules cross-border recipient country transferência internacional país terceiro",
    "Right": "right to access rectification erasure restriction portability objection automated decision opt-out data subject rights direito acesso",
    "Purpose": "processing purpose specific purpose objective goal finalidade purpose limitation specific consented purpose",
    "PersonalData": "personal data sensitive special category biometric health financial location behavioral dados pessoais dados sensíveis informação pessoal",
}

# Closed vocabularies.
ENUMS = {
    "ActorRole": ["DataSubject", "DataController", "DataProcessor", "ThirdParty"],
    "ProcessingAction": ["Collect", "Store", "Use", "Share", "Transfer", "Delete"],
    "LegalBasisType": ["Consent", "Contract", "LegalObligation", "LegitimateInterest", "VitalInterest", "PublicTask"],
    "PurposeCategory": ["ServiceProvision", "Security", "LegalCompliance", "Marketing", "Analytics", "Research"],
    "ConstraintType": ["Temporal", "Geographic", "Usage", "Security", "Retention", "PurposeLimitation"],
    "RightType": ["Access", "Rectification", "Erasure", "Restriction", "Portability", "Objection", "AutomatedDecisionOptOut"],
    "RetentionUnit": ["Days", "Months", "Years", "Indefinite"],
    "RetentionTrigger": ["CollectionDate", "ContractEnd", "LastActivity", "LegalObligationExpiry", "ConsentWithdrawal", "AccountDeletion"],
    "WithdrawalChannel": ["OnlineForm", "Email", "WrittenRequest", "InAppToggle", "PhoneRequest", "InPerson"],
    "TransferMechanism": ["AdequacyDecision", "StandardContractualClauses", "BindingCorporateRules", "Consent", "ContractNecessity", "LegitimateInterest", "Other"],
    "PersonalDataCategory": ["Identifier", "ContactInformation", "LocationData", "FinancialData", "HealthData", "BiometricData", "BehavioralData", "TechnicalData", "ContentData"],
    "SensitivityLevel": ["Low", "Medium", "High", "SpecialCategory"],
    "Identifiability": ["Identified", "Pseudonymous", "Anonymous"],
}

# Concepts extracted of each article, those of which a statement holds a list, and the field that tells absence.
PASS1_CONCEPTS = ["LegalBasis", "ProcessingActivity", "Actor", "Purpose", "Right", "Constraint", "RetentionPolicy", "DataTransfer", "ConsentWithdrawal"]
LIST_CONCEPTS = ["Purpose", "Right", "Constraint", "RetentionPolicy", "DataTransfer", "ConsentWithdrawal"]
SIGNAL_FIELD = {"LegalBasis": "evidence", "ProcessingActivity": "description", "Actor": "name", "Purpose": "description", "Right": "type", "Constraint": "expression", "RetentionPolicy": "duration", "DataTransfer": "mechanism", "ConsentWithdrawal": "channel"}
JURISDICTIONS = {
    "GDPR": ("EU", "European Union", "EU General Data Protection Regulation"),
    "LGPD": ("BR", "Brazil", "Lei Geral de Proteção de Dados Pessoais"),
    "CCPA": ("CA-US", "California, United States", "California Consumer Privacy Act"),
    "CPRA": ("CA-US", "California, United States", "California Privacy Rights Act"),
    "PIPEDA": ("CA", "Canada", "Personal Information Protection and Electronic Documents Act"),
}
FALLBACKS = {c: "[]" for c in LIST_CONCEPTS} | {
    "LegalBasis": '{"basisId": "", "type": "LegalObligation", "evidence": "", "jurisdiction": [], "source_clause": ""}',
    "ProcessingActivity": '{"activityId": "", "description": "", "action": "Use", "riskAssessmentReference": null, "dataProcessed": [], "source_clause": ""}',
    "Actor": '{"actorId": "", "name": "", "role": "DataController", "source_clause": ""}',
}

# Dimensions of the coverage matrix in order, with the statement column of each; then those of a delta, with notes.
MATRIX = [
    ("Legal basis types", "legal_basis_types"), ("Rights granted", "right_types"), ("Constraint types", "constraint_types"), ("Purpose categories", "purpose_categories"),
    ("Transfer mechanisms", "transfer_mechanisms"), ("Retention rules", "has_retention"), ("DPIA/risk assessment", "has_dpia"), ("Consent withdrawal", "has_consent_withdrawal"),
]
DELTA = [
    ("legal basis types", "legal_basis_types", ""),
    ("data subject rights", "right_types", "Missing rights indicate reduced individual control."),
    ("transfer mechanisms", "transfer_mechanisms", "Missing mechanisms restrict lawful international data flows."),
    ("constraint types", "constraint_types", "Missing constraint types suggest fewer operational restrictions."),
    ("purpose categories", "purpose_categories", ""),
    ("retention policy mandate", "has_retention", "{a} requires storage limitation; {b} does not enforce it at scale."),
    ("risk/impact assessment mandate", "has_dpia", "{a} mandates DPIA for high-risk processing; {b} treats it as optional."),
    ("consent withdrawal mandate", "has_consent_withdrawal", "{a} requires withdrawal mechanics; {b} has weaker or no equivalent."),
]
STRUCTURAL_LEVELS = ["article", "section", "principle", "document"]
MIN_CHUNK, MAX_CHUNK, MIN_SEGMENT, TOP_K, RETRIES, MANDATE, MAX_TERMS = 100, 4000, 30, 3, 2, 0.3, 4096
