"""Prompts of both passes: one for each concept with a guide to its closed values, a worked example and what to answer if nothing is
stated; and one that puts the parts of an article together."""

from __future__ import annotations

from dataclasses import dataclass, field

from lexloom.config import ENUMS, PASS1_CONCEPTS
from lexloom.operators.validate import CLASSES

SYSTEM = "You extract facts from the text of a law. Answer with one JSON object and nothing else. Leave out what the text does not state. Use only the listed values for closed fields."

# The keys that stand for "nothing stated".
SENTINELS = {"RetentionPolicy": "_no_retention_stated", "ConsentWithdrawal": "_no_withdrawal_stated", "Right": "_no_right_stated", "DataTransfer": "_no_transfer_stated"}


@dataclass(frozen=True)
class Guide:
    """task: what to look for; signs: wording that tells each value of a closed field; example: a text and its answer."""

    task: str
    signs: dict[str, dict[str, str]] = field(default_factory=dict)
    example: tuple[str, str] = ("", "")


GUIDES: dict[str, Guide] = {
    "LegalBasis": Guide(
        "the ground on which the provision lets personal data be processed; quote the words that say so as evidence",
        {"type": {"Consent": "the person agrees, opts in or accepts", "Contract": "needed to make or carry out an agreement with the person", "LegalObligation": "another rule compels the controller", "LegitimateInterest": "an interest of the controller or a third party outweighs", "VitalInterest": "life or bodily safety is at stake", "PublicTask": "an authority acts, or the public interest is served"}},
        ("A clinic may record allergies where the patient has agreed to it in writing.", '{"type": "Consent", "evidence": "where the patient has agreed to it in writing", "jurisdiction": [{"name": "European Union"}]}'),
    ),
    "ProcessingActivity": Guide(
        "the main thing that is done with the data, and which data that is; name a risk or impact assessment only if the text refers to one",
        {
            "action": {"Collect": "obtain, gather, record", "Store": "keep, hold, archive", "Use": "consult, analyse, any other handling", "Share": "disclose or make available at home", "Transfer": "send to another country", "Delete": "erase, destroy, make anonymous for good"},
            "sensitivity": {"SpecialCategory": "health, biometrics, genetics, belief, ethnicity, sex life, union membership", "High": "money, precise location, children, criminal record", "Medium": "contact details, accounts, identifiers", "Low": "what is public or says little of a person"},
        },
        ("Employers shall archive payslips of their staff.", '{"description": "archiving of payslips", "action": "Store", "dataProcessed": [{"description": "payslips", "source": "employer", "category": "FinancialData", "sensitivity": "High", "identifiability": "Identified"}]}'),
    ),
    "RetentionPolicy": Guide(
        "how long data may be kept and from what event on; a period without a number is Indefinite with a duration of -1",
        {"trigger": {"CollectionDate": "from the day the data were obtained, or no event named", "ContractEnd": "when the agreement ends", "LastActivity": "since the person was last active", "LegalObligationExpiry": "once no rule demands them any more", "ConsentWithdrawal": "when agreement is taken back", "AccountDeletion": "when the account is closed"}},
        ("Invoices are destroyed seven years after the agreement has ended.", '{"duration": 7, "unit": "Years", "trigger": "ContractEnd"}'),
    ),
    "ConsentWithdrawal": Guide(
        "how agreement can be taken back, by when it has effect, and what becomes of earlier processing",
        {"channel": {"OnlineForm": "a web page or link", "Email": "a message to an address", "WrittenRequest": "a letter or signed form", "InAppToggle": "a setting of the product", "PhoneRequest": "a call", "InPerson": "at a desk"}},
        ("Members may revoke their agreement by letter at any time; what was done before stays lawful.", '{"channel": ["WrittenRequest"], "deadline": "at any time", "effectOnPriorProcessing": "what was done before stays lawful"}'),
    ),
    "Right": Guide(
        "what the person may demand, when, and how it is met",
        {"type": {"Access": "see or get a copy of the data", "Rectification": "have errors put right", "Erasure": "have the data removed", "Restriction": "have the use held back", "Portability": "take the data elsewhere in a common format", "Objection": "refuse a use or a sale", "AutomatedDecisionOptOut": "not be subject to a machine's decision alone"}},
        ("On request, the bureau shall correct a wrong address within a week.", '{"type": "Rectification", "triggerCondition": "on request, where an address is wrong", "fulfillmentProcess": "corrected within a week"}'),
    ),
    "Purpose": Guide(
        "what the data are processed for",
        {"category": {"ServiceProvision": "to deliver what was asked for", "Security": "to guard against fraud, attack or harm", "LegalCompliance": "to meet a duty or a claim", "Marketing": "to advertise", "Analytics": "to measure, profile or improve", "Research": "science, history, statistics"}},
        ("Readings may be used to bill the household for its power.", '{"description": "billing of power", "category": "ServiceProvision"}'),
    ),
    "DataTransfer": Guide(
        "the passing of data to another country or an international body, and what makes it lawful; an adequacy decision has to be named",
        {"mechanism": {"AdequacyDecision": "the destination is found to protect data well enough", "StandardContractualClauses": "model clauses are signed", "BindingCorporateRules": "approved rules of a group of companies", "Consent": "the person agreed to this transfer", "ContractNecessity": "an agreement with or for the person needs it", "LegitimateInterest": "a compelling interest of the sender", "Other": "none of these"}},
        ("Crew lists may go to ports abroad under model clauses.", '{"mechanism": "StandardContractualClauses", "destinationJurisdiction": [{"name": "port states"}], "dataTransferred": [{"description": "crew lists", "source": "ship", "category": "Identifier", "sensitivity": "Medium", "identifiability": "Identified"}]}'),
    ),
    "Constraint": Guide(
        "a limit or duty on processing, as a short expression; how binding it is goes by its verb: SHALL for shall, must and may not, SHOULD for should, MAY for may",
        {"type": {"Temporal": "a time by which or during which", "Geographic": "a place or border", "Usage": "what may be done, how much, how exactly", "Security": "safeguards, confidentiality, breaches", "Retention": "storage no longer than needed", "PurposeLimitation": "only for the stated aim"}},
        ("Footage must be encrypted.", '{"type": "Security", "expression": "footage is encrypted", "enforcementLevel": "SHALL"}'),
    ),
    "Actor": Guide(
        "who the provision mainly speaks to or about",
        {"role": {"DataSubject": "the person whose data they are: consumer, patient, employee", "DataController": "who decides why and how: business, authority, organisation", "DataProcessor": "who acts for another: service provider, contractor", "ThirdParty": "anyone else, such as a buyer or recipient"}},
        ("A contractor acts only on the school's instructions.", '{"name": "contractor", "role": "DataProcessor"}'),
    ),
    "PersonalData": Guide(
        "one kind of personal data that the provision names",
        {
            "category": {"Identifier": "names, numbers", "ContactInformation": "addresses, phone", "LocationData": "whereabouts", "FinancialData": "accounts, income", "HealthData": "body and mind", "BiometricData": "face, finger, voice, genes", "BehavioralData": "habits, browsing, purchases", "TechnicalData": "devices, logs, network addresses", "ContentData": "messages, pictures, documents"},
            "identifiability": {"Identified": "the person is known", "Pseudonymous": "known with a key kept apart", "Anonymous": "nobody can tell any more"},
        },
        ("Fingerprints taken at the gate are kept under a number.", '{"description": "fingerprints", "source": "gate", "category": "BiometricData", "sensitivity": "SpecialCategory", "identifiability": "Pseudonymous"}'),
    ),
}


def fields(concept: str) -> str:
    def shown(f) -> str:
        kind = " or ".join(ENUMS[f.kind]) if f.kind in ENUMS else f.kind
        return f"{f.name}{'' if f.required else ' (optional)'}: {'list of ' if f.many else ''}{kind}"

    return "; ".join(shown(f) for f in CLASSES[concept])


def body(concept: str) -> str:
    """What a concept's prompt says between the provision and its text."""
    g = GUIDES[concept]
    lines = [f"Find: {concept}, {g.task}.", f"Fields: {fields(concept)}"]
    needed = sorted({f.kind for f in CLASSES[concept] if f.kind in CLASSES})
    lines += [f"{name}: {fields(name)}" for name in needed]
    for name, signs in g.signs.items():
        lines += [f"How to choose {name}:", *[f"- {value}: {sign}" for value, sign in signs.items()]]
    lines += [f"Example text: {g.example[0]}", f"Example answer: {g.example[1]}"]
    lines.append(f'If the text states nothing of the kind, answer {{"{SENTINELS[concept]}": true}}.' if concept in SENTINELS else "If the text states nothing of the kind, answer {}.")
    return "\n".join(lines)


def build_prompt(concept: str, law: str, ref: str, text: str) -> tuple[str, str]:
    """(system, user); an unknown concept is refused."""
    if concept not in GUIDES:
        raise ValueError(f"unknown concept {concept}")
    return SYSTEM, f"Law: {law}\nProvision: {ref}\n{body(concept)}\n\nText:\n{text}"


def build_assembly(law: str, ref: str, parts: dict[str, str], regulation: str) -> tuple[str, str]:
    """(system, user) of the second pass. parts: the JSON of each concept, a list for those of which a statement holds several."""
    rules = "Put the fields straight into the object, without a key around them. Write field names exactly as given, without an underscore before them."
    shown = [f"{c}: {parts.get(c) or 'none'}" for c in PASS1_CONCEPTS]
    lines = [f"Law: {law}", f"Provision: {ref}", "Make one PolicyStatement of these parts. Describe the provision in one sentence. Take the parts as they are and add none; lists may be empty only where a field is optional.", f"Fields: {fields('PolicyStatement')}", f"source_clause is {ref}.", "Parts:", *shown, f"governingRegulations: {regulation}"]
    return f"{SYSTEM} {rules}", "\n".join(lines)


def corrective(user: str, errors: list[str]) -> str:
    return user + "\n\nThe last answer was refused:\n" + "\n".join(f"- {e}" for e in errors) + "\nAnswer again with one JSON object."
