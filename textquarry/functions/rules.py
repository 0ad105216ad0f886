"""Tables of patterns, words and weights that the rule-driven operators compile into columns.

Patterns are written for Java's regular expressions without flags; those who use them add `(?i)`.
"""

from __future__ import annotations

# Dictionaries that tag a chunk; a tag applies if one of its words is a substring of the lower-cased text.
VISA_WORDS = {
    "H-1B": ["h-1b", "h1b", "specialty occupation", "214.2(h)"],
    "H-2A": ["h-2a", "h2a", "agricultural worker"],
    "H-2B": ["h-2b", "h2b", "temporary nonagricultural"],
    "H-4": ["h-4", "h4", "214.2(h)(9)(iv)", "h-4 dependent"],
    "F-1": ["f-1", "f1", "214.2(f)", "sevis", "student visa"],
    "F-2": ["f-2", "f2", "214.2(f)(3)"],
    "J-1": ["j-1", "j1", "214.2(j)", "exchange visitor"],
    "J-2": ["j-2", "j2"],
    "L-1": ["l-1", "l1", "intracompany transferee", "214.2(l)"],
    "O-1": ["o-1", "o1", "extraordinary ability", "214.2(o)"],
    "TN": ["tn status", "trade nafta", "usmca", "214.6"],
    "B-1": ["b-1", "b1", "business visitor", "214.2(b)"],
    "B-2": ["b-2", "b2", "tourist", "pleasure visitor"],
    "asylum": ["asylum", "asylee", "208.", "pending asylum", "affirmative asylum"],
    "refugee": ["refugee", "207.", "refugee status"],
    "green_card": ["lawful permanent resident", "lpr", "permanent residence", "adjustment of status", "245."],
    "EAD": ["employment authorization", "274a.12", "i-765", "ead", "work permit"],
    "OPT": ["optional practical training", "opt", "stem opt", "214.2(f)(10)"],
    "CPT": ["curricular practical training", "cpt", "214.2(f)(10)(i)"],
    "DACA": ["daca", "deferred action", "childhood arrivals"],
    "TPS": ["temporary protected status", "tps", "244."],
    "removal": ["removal proceedings", "deportation", "239.", "notice to appear"],
    "naturalization": ["naturalization", "citizenship", "316.", "n-400"],
    "parole": ["parole", "212.5", "humanitarian parole"],
    "VAWA": ["vawa", "violence against women", "204.2(c)"],
}
TOPIC_WORDS = {
    "employment_authorization": ["employment authorization", "work permit", "authorized to work", "274a"],
    "status_maintenance": ["maintain status", "status violation", "out of status", "unlawful presence"],
    "extension": ["extension of stay", "extend status", "i-129", "i-539"],
    "change_of_status": ["change of status", "change nonimmigrant", "i-539"],
    "adjustment_of_status": ["adjustment of status", "i-485", "245.", "lawful permanent"],
    "travel": ["advance parole", "travel document", "reentry permit", "131."],
    "cap": ["h-1b cap", "annual cap", "numerical limit", "lottery"],
    "portability": ["portability", "ac21", "180 days", "same or similar"],
    "premium_processing": ["premium processing", "i-907", "expedite"],
    "petition": ["petition", "i-129", "i-140", "i-130", "i-360"],
    "interview": ["interview", "consular", "visa interview"],
    "biometrics": ["biometrics", "fingerprint", "asis"],
    "fee": ["filing fee", "fee waiver", "i-912"],
    "appeal": ["appeal", "motion to reopen", "bia", "aao"],
    "inadmissibility": ["inadmissible", "grounds of inadmissibility", "212(a)"],
    "deportability": ["deportable", "grounds of deportability", "237(a)"],
    "bond": ["bond", "custody", "detention", "236."],
    "asylum_application": ["asylum application", "i-589", "one year", "bar to asylum"],
    "withholding": ["withholding of removal", "cat", "convention against torture"],
}
FORM_WORDS = {
    "I-129": ["i-129", "form i-129", "petition for nonimmigrant worker"],
    "I-130": ["i-130", "form i-130", "petition for alien relative"],
    "I-131": ["i-131", "form i-131", "travel document"],
    "I-140": ["i-140", "form i-140", "immigrant petition"],
    "I-485": ["i-485", "form i-485", "adjustment of status application"],
    "I-539": ["i-539", "form i-539", "change or extend status"],
    "I-589": ["i-589", "form i-589", "asylum application"],
    "I-601": ["i-601", "form i-601", "waiver"],
    "I-765": ["i-765", "form i-765", "employment authorization"],
    "I-797": ["i-797", "form i-797", "notice of action"],
    "I-864": ["i-864", "form i-864", "affidavit of support"],
    "I-90": ["i-90", "form i-90", "renew green card"],
    "I-9": [" i-9 ", "form i-9", "employment eligibility verification"],
    "N-400": ["n-400", "form n-400", "naturalization application"],
    "DS-160": ["ds-160", "nonimmigrant visa application"],
}
ACTION_WORDS = {
    "file": ["must file", "shall file", "may file", "submit", "filing"],
    "renew": ["renew", "renewal", "extend"],
    "apply": ["apply", "application", "request"],
    "travel": ["travel", "depart", "return", "reentry"],
    "change_employer": ["change employer", "new employer", "portability"],
    "work": ["authorized to work", "employment authorized", "begin work"],
    "appeal": ["appeal", "motion to reopen", "motion to reconsider"],
    "interview": ["appear for interview", "attend interview"],
}
CONDITION_WORDS = {
    "pending_application": ["application is pending", "while pending", "pending adjudication"],
    "cap_gap": ["cap-gap", "cap gap", "october 1"],
    "expired_status": ["expired", "status expired", "out of status"],
    "overstay": ["overstay", "remained beyond", "unlawful presence"],
    "180_day_bar": ["180 days", "180-day bar", "unlawful presence bar"],
    "3_year_bar": ["3-year bar", "three year bar"],
    "10_year_bar": ["10-year bar", "ten year bar"],
    "criminal_conviction": ["convicted", "conviction", "criminal", "felony"],
    "previous_removal": ["previously removed", "prior removal order", "reinstated"],
    "stem_extension": ["stem extension", "24-month", "stem opt"],
}
RISK_WORDS = {
    "HIGH": ["removal", "deportation", "criminal", "conviction", "felony", "bar", "inadmissible", "unlawful presence", "overstay", "misrepresentation", "fraud", "permanently barred", "mandatory detention", "aggravated felony"],
    "MEDIUM": ["denial", "rejected", "out of status", "violation", "expired", "cap-gap", "pending", "overstay", "accruing unlawful", "employment authorization", "waiver required"],
}

# Source families by prefix of the version's name, the first that fits.
FAMILIES = [
    (("ecfr-title8-sample",), "eCFR Title 8 (sample — non-MVP)"),
    (("ecfr-title8-full", "ecfr-title8-smart", "ecfr-v"), "eCFR Title 8"),
    (("ina-",), "INA / U.S. Code Title 8"),
    (("uscis-pm-",), "USCIS Policy Manual"),
    (("uscis-official-pages",), "USCIS Official Pages"),
    (("bia-", "bia_"), "BIA Precedent Decisions"),
]

# Relevance boosts. Limits of the sum, the penalty of case law, tiers of authority by prefix of the citation.
MOST_BOOST, LEAST_BOOST, CASE_LAW_PENALTY = 0.028, -0.025, -0.022
AUTHORITY = [("USCIS Form", 0.006), ("USCIS Official", 0.006), ("8 CFR", 0.004), ("Vol ", 0.003), ("8 U.S.C.", 0.002)]
CASE_LAW_CITATION = r"\bBIA\b|I&N Dec\."
CASE_LAW_TOPIC = "bia precedent"
CASE_LAW_QUERY = ["bia", "board of immigration appeals", "precedent decision", "i&n dec"]
FORM_NUMBER = r"\bi[- ]?(\d{3,4}[a-z]?)\b"
FORM_BOOST = 0.014
# The first phrase of the query that has one of its needles in the chunk adds PHRASE_BOOST, and what PHRASE_MORE says.
PHRASES = [
    ("notice to appear", ["239.", "1239.", "notice to appear", "removal_proceeding"]),
    ("adjustment of status", ["245.", "1245.", "adjustment", "i-485"]),
    ("good moral character", ["316.", "moral character", "naturalization"]),
    ("advance parole", ["1245.13", "parole", "i-131", "part f"]),
    ("stem opt", ["214.2", "217.", "stem", "opt", "practical training"]),
    ("optional practical training", ["214.2", "opt", "practical training"]),
    ("request for evidence", ["rfe", "request for evidence", "part l"]),
    ("work authorization", ["274a.", "208.7", "244.", "employment authorization", "i-765"]),
    ("temporary protected status", ["244.", "tps", "274a.12"]),
    ("asylum", ["208.", "1158", "asylum"]),
    ("naturalization", ["316.", "naturalization", "n-400", "vol 12"]),
    ("removal", ["239.", "240.", "removal"]),
    ("overstay", ["244.", "unlawful presence", "245."]),
    ("crimes involving moral turpitude", ["moral turpitude", "cimt", "212(a)(2)", "237(a)(2)"]),
    ("aggravated felony", ["aggravated felony", "1101(a)(43)", "237(a)(2)", "iiraira"]),
    ("criminal inadmissibility", ["212(a)(2)", "1182(a)(2)", "criminal inadmissibility", "moral turpitude"]),
]
PHRASE_BOOST = 0.010
PHRASE_MORE = [("notice to appear", ["239."], 0.018), ("good moral character", ["316."], 0.016), ("stem opt", ["214.2", "217."], 0.014)]
# Every pattern of the query that has one of its needles in the chunk adds TOPIC_BOOST.
TOPIC_BOOST = 0.008
TOPICS = [
    (r"\basylum\b", ["208.", "1158", "asylum"]),
    (r"\btps\b|temporary protected", ["244.", "tps", "274a.12"]),
    (r"\bdaca\b", ["dac", "274a.12", "i-765"]),
    (r"\bstem\b|\bopt\b", ["214.2", "217.", "opt", "stem"]),
    (r"\bi[- ]?485\b|adjustment of status", ["1245.", "245.", "i-485"]),
    (r"\bi[- ]?765\b|\bead\b|employment authorization", ["274a.", "i-765", "217.2"]),
    (r"\bnotice to appear\b|\bnta\b", ["239.", "1239.", "notice to appear"]),
    (r"\brfe\b|request for evidence", ["rfe", "request for evidence", "part l"]),
    (r"\btravel\b.*\b485\b|485.*\bpending\b", ["1245.13", "advance parole", "i-131"]),
    (r"\bnaturalization\b|\bcitizen", ["316.", "naturalization", "vol 12"]),
    (r"\bfamily petition\b|\bi[- ]?130\b", ["i-130", "petition", "family"]),
    (r"\bi[- ]?864\b|affidavit of support", ["i-864", "213a", "affidavit"]),
    (r"\baddress\b.*\buscis\b|change of address", ["address", "265.", "official page"]),
    (r"\bcriminal\b.{0,60}\b(?:inadmissib|deportab|grounds?|conviction)\b", ["212(a)(2)", "237(a)(2)", "moral turpitude", "aggravated felony"]),
    (r"\bcimt\b|\bmoral turpitude\b", ["moral turpitude", "cimt", "212(a)(2)"]),
    (r"\baggravated felony\b", ["aggravated felony", "1101(a)(43)", "237(a)(2)"]),
]
# Contexts of the query.
TRAVEL = r"(\badvance parole\b.{0,100}\b(?:i[- ]?131|adjustment)\b|\bi[- ]?485\b.{0,80}\btravel\b|\btravel\b.{0,80}\bi[- ]?485\b|\badjustment of status\b.{0,80}\btravel\b|\btravel\b.{0,80}\badjustment of status\b)"
ASYLUM_EAD = r"(\basylu\w*\b.{0,120}\b(?:ead|i[- ]?765|work authorization|employment authorization)\b|\b(?:ead|i[- ]?765|work authorization|employment authorization)\b.{0,120}\basylu\w*\b|\bpending asylum\b)"
NATURALIZATION = r"(\bnaturalization\b.{0,100}\b(?:n-?400|continuous residence|physical presence|good moral character|english|civics)\b|\b(?:n-?400|continuous residence|physical presence)\b.{0,100}\bnaturalization\b)"
INADMISSIBILITY = r"(\bina\s*212\b|\b212\s*\(a\)\s*\(2\)\b|\bcriminal\s+(?:grounds?\s+of\s+)?inadmissib\w+|\bcrimes?\s+involving\s+moral\s+turpitude\b|\bcimt\b|\baggravated\s+felon\w+\b.{0,80}\b(?:immigration|inadmissib|visa|green\s+card|bar)\b|\bcontrolled\s+substance\b.{0,80}\binadmissib\w+\b)"
DEPORTABILITY = r"(\bina\s*237\b|\b237\s*\(a\)\s*\(2\)\b|\bcriminal\s+(?:grounds?\s+of\s+)?deportab\w+|\baggravated\s+felon\w+\b.{0,80}\b(?:deport\w+|removal)\b)"
H4_PROCESS = r"(\bh[- ]?4\b.{0,80}\b(?:dependent|spouse|status|process|nonimmigrant|change\s+of\s+status|extension)\b|\b214\.2\s*\(\s*h\s*\)\b|\bh[- ]?4\s+(?:dependent|visa|status)\b)"
H4_EAD = r"(\bh[- ]?4\b.{0,80}\b(?:ead|employment\s+authorization|work\s+authorization|i[- ]?765)\b|\b274a\.12\s*\(\s*c\s*\)\s*\(\s*26\s*\)\b|\bh[- ]?4\s+ead\b)"
OPT = r"(\boptional\s+practical\s+training\b|\b214\.2\s*\(\s*f\s*\)\b|\b274a\.12\s*\(\s*c\s*\)\s*\(\s*3\s*\)\b|\bpost[- ]?completion\s+opt\b|\bpre[- ]?completion\s+opt\b)"
# Signals in a chunk.
SYRIA = ["syrian", "public law 106-378", "public law 106378", "§ 1245.20", "§ 1245.19", "1245.20", "1245.19"]
T_STATUS = ["t nonimmigrant", "214.11", "t visa holder", "tvpa", "trafficking victim"]
PUBLIC_CHARGE = ["212(a)(4)", "1182(a)(4)", "public charge"]
SPECIAL_IMMIGRANT = ["101(a)(27)", "1101(a)(27)", "special immigrant"]
MORAL_CHARACTER = ["316.", "n-400", "n400", "vol 12", "naturalization"]
CRIMINAL_GROUNDS = ["212(a)(2)", "1182(a)(2)", "237(a)(2)", "1227(a)(2)", "criminal grounds", "criminal inadmissibility", "criminal deportability", "moral turpitude"]
ASYLUM_FILING = ["i-589", "208.1", "208.2", "208.3", "208.4", "208.5", "208.6", "asylum eligibility", "asylum application"]
SUPPORT = ["i-864", "i864", "213a", "affidavit of support"]
_CITIZEN = ["naturalization", "citizen"]
_OTHER_STATUS = [(-0.018, MORAL_CHARACTER, _CITIZEN, []), (-0.016, SPECIAL_IMMIGRANT, [], []), (-0.016, SUPPORT, [], [])]
# In each context of the query, (weight, one of these in the chunk, none of these in the query, none of these in the chunk).
CONTEXTS = [
    (TRAVEL, [(0.012, ["advance parole", "i-131", "travel document", "abandonment", "1245.13"], [], []), (-0.024, SYRIA, ["syr", "public law 106"], []), (-0.022, T_STATUS, ["t nonimmig", "t visa", "trafficking", "tvpa"], [])]),
    (ASYLUM_EAD, [(0.016, ["208.7"], [], []), (0.010, ["274a.12"], [], []), (0.008, ["i-765"], [], [])]),
    (NATURALIZATION, [(0.016, ["n-400", "n400"], [], []), (0.012, ["316."], [], []), (0.010, ["vol 12"], [], []), (0.008, ["continuous residence", "physical presence"], [], [])]),
    (r"n-?400", [(0.014, ["n-400", "n400"], [], [])]),
    (r"\bcategor", [(0.012, ["274a.12"], [], [])]),
    (INADMISSIBILITY, [
        (0.012, ["212(a)(2)", "1182(a)(2)", "moral turpitude", "cimt", "criminal inadmissibility", "inadmissibility", "aggravated felony", "controlled substance"], [], []),
        (0.008, ["212(a)(2)", "1182(a)(2)"], [], []), (-0.018, PUBLIC_CHARGE, [], []), (-0.014, SPECIAL_IMMIGRANT, [], []), (-0.012, MORAL_CHARACTER, _CITIZEN, CRIMINAL_GROUNDS)]),
    (DEPORTABILITY, [
        (0.012, ["237(a)(2)", "1227(a)(2)", "criminal deportability", "deportability", "aggravated felony", "moral turpitude"], [], []),
        (0.008, ["237(a)(2)", "1227(a)(2)"], [], []), (-0.018, PUBLIC_CHARGE, [], []), (-0.014, SPECIAL_IMMIGRANT, [], []), (-0.012, ASYLUM_FILING, ["asylum"], CRIMINAL_GROUNDS)]),
    (H4_PROCESS, [(0.016, ["214.2(h)"], [], []), (0.008, ["h-4", "h4"], [], []), (0.008, ["i-539"], [], []), *_OTHER_STATUS]),
    (H4_EAD, [(0.016, ["274a.12(c)(26)"], [], []), (0.010, ["274a.12"], [], []), (0.008, ["i-765"], [], []), *_OTHER_STATUS]),
    (OPT, [(0.014, ["214.2(f)"], [], []), (0.012, ["274a.12(c)(3)"], [], []), (0.008, ["i-765"], [], []), (0.006, ["optional practical training"], [], []), *_OTHER_STATUS]),
]

# What a question mentions; names in order, the patterns on the lower-cased question.
VISA_PATTERNS = {
    "H-1B": [r"\bh-?1b\b", "specialty occupation", "h1b"],
    "H-4": [r"\bh-?4\b", "h4 ead", "h-4 dependent"],
    "H-4 EAD": ["h-?4 ead", "h4ead", "h-4 employment"],
    "F-1": [r"\bf-?1\b", "student visa", "sevis", r"\bopt\b", r"\bcpt\b"],
    "OPT": [r"\bopt\b", "optional practical training", "stem opt"],
    "J-1": [r"\bj-?1\b", "exchange visitor"],
    "L-1": [r"\bl-?1\b", "intracompany"],
    "O-1": [r"\bo-?1\b", "extraordinary ability"],
    "TN": [r"\btn\b", "trade nafta", "usmca"],
    "asylum": [r"\basylum\b", "asylee", "asylum applicant"],
    "EAD": [r"\bead\b", "employment authorization", "work permit", "i-765", "form i-765"],
    "green_card": ["green card", "lawful permanent", r"\blpr\b", "adjustment of status", "i-485"],
    "naturalization": ["naturalization", "citizenship", "n-400"],
    "removal": ["removal", "deportation", "notice to appear"],
    "TPS": [r"\btps\b", "temporary protected status"],
    "DACA": [r"\bdaca\b", "deferred action"],
    "parole": [r"\bparole\b", "advance parole"],
    "cap_gap": ["cap.?gap", "october 1", "h-1b cap"],
    "221g": [r"221\(?g\)?", "blue slip", "administrative processing"],
    "consular": ["consular", "visa stamp", "stamping", "embassy", "consulate"],
    "I-94": [r"\bi-94\b", "admission record"],
    "I-140": [r"\bi-140\b", "immigrant petition"],
    "pending": ["pending", "while.*pending", "application.*pending"],
}
TOPIC_PATTERNS = {
    "employment_authorization": ["can i work", "authorized to work", "work.*while", "continue working", "start working"],
    "extension": ["extend", "extension", "renew", "renewal"],
    "travel": ["travel", "return.*us", "leave.*us", "reenter"],
    "status_maintenance": ["maintain.*status", "out of status", "status.*expire"],
    "change_employer": ["change.*employer", "new.*employer", r"transfer.*h.?1b"],
    "dependent": ["spouse", "dependent", "family member", "child"],
    "interview": ["interview", "stamping", "consular"],
}
# What is asked besides the question for each name.
VISA_QUERIES = {
    "H-1B": "H-1B nonimmigrant worker visa regulations employment",
    "H-4": "H-4 dependent nonimmigrant status regulations",
    "H-4 EAD": "H-4 EAD employment authorization form I-765 pending renewal",
    "F-1": "F-1 student visa status regulations SEVIS",
    "OPT": "F-1 OPT optional practical training employment authorization",
    "asylum": "asylum application pending employment authorization",
    "EAD": "employment authorization document I-765 application",
    "green_card": "adjustment of status lawful permanent resident I-485",
    "naturalization": "naturalization citizenship application N-400",
    "cap_gap": "H-1B cap gap employment authorization October 1",
    "221g": "221(g) administrative processing consular visa refusal",
    "consular": "consular processing visa stamping interview",
    "removal": "removal proceedings deportation notice to appear",
    "TPS": "temporary protected status employment authorization",
    "parole": "advance parole travel document pending application",
    "I-140": "I-140 immigrant petition approved employment authorization",
}
TOPIC_QUERIES = {
    "employment_authorization": "employment authorization work permit while application pending",
    "extension": "extension of status renewal application pending",
    "travel": "travel outside united states reentry return status",
    "change_employer": "change employer H-1B portability AC21",
    "dependent": "dependent spouse employment authorization status",
    "interview": "consular interview visa stamping administrative processing",
}
# Fixed values: (all of these mentioned, or this word in the question, what is asked besides).
PAIR_QUERIES = [
    (["H-4 EAD", "H-1B"], None, "H-4 EAD automatic extension H-1B extension pending I-765 renewal cap gap"),
    (["asylum", "EAD|employment_authorization"], None, "asylum applicant employment authorization I-765 180 day rule 274a.12(c)(8)"),
    (["OPT"], "stem", "F-1 STEM OPT 24 month extension employment authorization"),
    (["221g", "H-1B"], None, "H-1B visa 221(g) administrative processing consular return status"),
]
FILTER_TAGS = {"H-1B": "H-1B", "H-4": "H-4", "H-4 EAD": "H-4", "F-1": "F-1", "OPT": "F-1", "asylum": "asylum", "EAD": "EAD", "green_card": "green_card", "naturalization": "naturalization", "TPS": "TPS", "DACA": "DACA", "parole": "parole"}

# Metadata reranking.
VISA_WEIGHT, TOPIC_WEIGHT, FORM_WEIGHT, SECTION_WEIGHT, NO_MATCH = 0.04, 0.03, 0.02, 0.05, 0.6
VISA_SECTIONS = {
    "H-1B": ["214.2(h)", "214.2"],
    "H-4": ["214.2(h)(9)", "214.2"],
    "EAD": ["274a.12", "274a.13"],
    "H-4 EAD": ["274a.12(c)(26)", "274a.12", "214.2(h)(9)(iv)"],
    "F-1": ["214.2(f)"],
    "OPT": ["214.2(f)(10)", "274a.12(c)(3)"],
    "asylum": ["208.", "274a.12(c)(8)"],
    "green_card": ["245."],
    "naturalization": ["316.", "312."],
    "TPS": ["244."],
    "removal": ["239.", "240."],
    "L-1": ["214.2(l)"],
    "O-1": ["214.2(o)"],
}
FORMS = ["I-765", "I-129", "I-140", "I-485", "I-539", "I-589", "I-130", "I-131", "N-400"]
TOPIC_KEYWORDS = {
    "employment_authorization": ["employment authorization", "authorized to work", "work permit", "ead"],
    "extension": ["extension", "renew", "renewal"],
    "travel": ["travel", "advance parole", "reentry"],
    "change_employer": ["change employer", "portability"],
    "dependent": ["spouse", "dependent", "h-4"],
    "interview": ["interview", "consular", "stamping"],
    "status_maintenance": ["maintain status", "out of status"],
}

# Message classes.
GREETING_CHARS = 80
GREETINGS = [r"^(hi|hello|hey|hiya|howdy)[!.,? ]*$", r"^(thanks|thank you|thank u|ty)[!.,? ]*$", r"^how are you( doing| today)?[?!.,]*$", r"^(good morning|good afternoon|good evening|good day)[!.,? ]*$", r"^(greetings|salutations)[!.,? ]*$", r"^(ok|okay|got it|i see|understood|great|perfect|sounds good)[!.,? ]*$"]
CONSEQUENCE = r"^(what (happens?|are the consequences?|is the penalty|is the punishment|are the risks?|could happen|will happen)|what could happen|what will happen|what is the risk|what if i)"
CRIMINAL_MATTER = r"\b(dui|dwi|hit[- ]and[- ]run|hit and run|arrest(?:ed)?|conviction|convicted|criminal (?:charge|case|matter|record|history)|theft|robbery|assault|battery|burglary|felony|misdemeanor|drug (?:charge|offense|arrest|conviction)|domestic violence)\b"
CRIMINAL_ACTION = r"\b(what should (?:i|we) do|what do i do|what can (?:i|we) do|how (?:do|should|can) (?:i|we) (?:handle|deal with|proceed|approach)|how to (?:handle|deal with|proceed)|what are (?:my|our) (?:options|next steps|choices)|what (?:is|are) my next steps?|advise me|help me (?:deal with|handle|navigate))\b"
REFUSALS = [
    r"\bhide\b.{0,80}\bfrom\b.{0,50}\b(uscis|immigration|dhs|cbp|ice|officer|agent|government)\b",
    r"\b(how (do i|can i|should i|could i|to)|want to|trying to)\b.{0,60}\b(conceal|omit|hide|cover up)\b.{0,60}\b(arrest|conviction|criminal|record|charge|removal|deportation)\b",
    r"\b(how (do i|can i|should i|could i)|is it (ok|okay|possible|safe) to|can i|trying to)\b.{0,80}\b(lie|lying)\b.{0,60}\b(application|form|i-485|i-131|n-400|visa|uscis|interview)\b",
    r"\blie\b.{0,40}\b(about|on)\b.{0,40}\b(application|form|i-485|i-131|n-400|visa|immigration form)\b",
    r"\bcan i\b.{0,60}\blie\b.{0,30}\b(about|my)\b.{0,60}\b(arrest|conviction|criminal|deportation|removal|felony|misdemeanor)\b",
    r"\b(fake|forge|forgery|falsif|fabricat)\b.{0,60}\b(documents?|id|passport|visa|records?|certificate|papers?|supporting)\b",
    r"\b(how (do i|can i|should i|to)|want to|trying to)\b.{0,60}\bmisrepresent\b",
    r"\bevade\b.{0,60}\b(ice|immigration enforcement|deportation|removal|officer|agent)\b",
    r"\b(how (do i|can i|should i|to))\b.{0,60}\b(avoid|evade|escape)\b.{0,60}\b(ice|deportation|removal|enforcement)\b",
    r"\bescape\b.{0,50}\b(ice|detention|custody|removal|deportation|immigration officers?)\b",
    r"\b(hide|conceal|omit)\b.{0,80}\b(arrest|criminal|conviction|charge|felony|misdemeanor|record)\b.{0,80}\b(application|form|green card|uscis|visa|immigration)\b",
    r"\b(how (can i|do i|should i|to))\b.{0,80}\b(avoid|skip|miss)\b.{0,60}\b(immigration court|court (?:hearing|date|appearance))\b",
]
HIGH_RISK = [r"\bnotice to appear\b", r"\bnta\b", r"\bremoval\b", r"\bdeportation\b", r"\bimmigration court\b", r"\bcourt hearing\b", r"\basylum\b.*\b(deadline|one year|1 year|barred)\b", r"\b(one year|1 year)\b.*\basylum\b", r"\bunlawful presence\b", r"\boverstay\b", r"\bvisa overstay\b", r"\bcriminal\b", r"\bfraud\b", r"\bmisrepresent\b", r"\bprior denial\b", r"\bdenied\b.*\b(visa|petition|application)\b", r"\bdetention\b", r"\bice\b.*\b(custody|detain)\b"]
SECTIONS = ["Short answer", "What this means", "Typical next steps", "Official sources", "Important caution"]
# What is added to an answer that lacks parts of its form.
CAUTION = "This is general information from the retrieved sources only, not legal advice. You may wish to consult a qualified immigration attorney for your situation."
RISK_CAUTION = " This topic can have serious consequences if deadlines or court dates are missed. Consider speaking with a qualified immigration attorney promptly."
WRAP = {
    "What this means": "See the short answer above.",
    "Typical next steps": "1. Review the official sources listed in this app.\n2. Confirm requirements on the official government pages cited.\n3. Consult a qualified immigration attorney if your situation is urgent or complex.",
    "Official sources": "(See citations below.)",
}
# Citations of asylum rules, and parts of a citation that clear one of them.
ASYLUM_CITATION = r"208\.|asylum"
NOT_ASYLUM = ["217", "214.2", "765", "274a"]

# Routes of a question, the first that fits: (topic, intent, all of these patterns, what is asked instead, preferred families).
_REGULATIONS = ["eCFR Title 8", "USCIS Policy Manual"]
_WORK = r"\b(?:work|employ\w*|ead|employment\s+authorization|authorized)\b"
_OPT_WORK = r"\b(?:work|employ\w*|ead|employment\s+authorization|authorized|after\s+graduation|post[- ]?completion|internship|eligib\w*)\b"
ROUTES = [
    ("nta_removal_high_risk", "case_specific_or_risk", [r"\b(?:I\s+received|I\s+got|I\s+have|I\s+was\s+given|I\s+was\s+served|we\s+received|we\s+got|my\s+NTA|our\s+NTA|after\s+receiving|receiving\s+a\s+Notice\s+to\s+Appear|received\s+an?\s+NTA|got\s+an?\s+NTA|I(?:'m|\s+am)\s+in\s+removal\s+proceedings)\b", r"\b(?:NTA|Notice\s+to\s+Appear|removal\s+proceedings|immigration\s+court|removal\s+order|EOIR)\b"],
     "Notice to Appear NTA removal proceedings immigration court 8 CFR 239.1 EOIR right to counsel immigration attorney accredited representative master calendar hearing individual hearing in absentia removal order removal defense BIA Board of Immigration Appeals I&N Dec. precedent decision", [*_REGULATIONS, "BIA Precedent Decisions"]),
    ("i485_advance_parole", "case_specific_or_risk", [r"\bI[- ]?485\b|adjustment\s+of\s+status|adjustment\s+(?:application|pending|case)|pending\s+(?:adjustment|green\s+card\s+application)|applied\s+for\s+(?:a\s+)?green\s+card", r"\b(?:travel|advance\s+parole|Form\s+I[- ]?131|I[- ]?131|travel\s+document|go\s+abroad|leave\s+the\s+(?:country|US|U\.S\.?))\b"],
     "advance parole I-485 adjustment of status pending Form I-131 travel document abandonment 8 CFR 245.2 travel abroad return approval before departure risk of abandonment adjustment pending travel", _REGULATIONS),
    ("asylum_ead", "case_specific_or_risk", [r"\b(?:asylum|asylee|affirmative\s+asylum|filed\s+asylum|filing\s+asylum|pending\s+asylum|asylum\s+applicant|asylum\s+application|I[- ]?589)\b", r"\b(?:ead|employment\s+authorization|work\s+permit|work\s+authorization|Form\s+I[- ]?765|I[- ]?765|authorized\s+to\s+work|work\s+(?:while|after|before|timing)|permission\s+to\s+work)\b"],
     "pending asylum applicant employment authorization EAD 8 CFR 208.7 Form I-765 274a.12(c)(8) 180-day waiting period asylee applicant affirmative asylum work permit category c8 employment authorization document", _REGULATIONS),
    ("stem_opt", "general_info", [r"\bstem\s+opt\b"],
     "STEM OPT extension 24-month F-1 STEM degree 8 CFR 214.2(f)(10)(ii)(C) Form I-983 Training Plan E-Verify employer 274a.12(c)(3)(C) science technology engineering mathematics", _REGULATIONS),
    ("f1_cpt", "general_info", [r"\bcpt\b|curricul(?:ar|um)\s+practical\s+training", r"\bf[- ]?1\b|\bstudent\b|\bi[- ]?20\b|" + _OPT_WORK],
     "F-1 CPT curricular practical training 8 CFR 214.2(f)(10)(i) cooperative education internship practicum DSO authorization I-20 SEVIS integral part of established curriculum", _REGULATIONS),
    ("f1_opt", "general_info", [r"\bopt\b|optional\s+practical\s+training", _OPT_WORK],
     "F-1 optional practical training OPT post-completion OPT 8 CFR 214.2(f)(10) Form I-765 274a.12(c)(3) employment authorization DSO SEVIS graduation academic degree field of study", _REGULATIONS),
    ("l2_work_authorization", "general_info", [r"\bl[- ]?1\b", r"\b(?:spouse|wife|husband|dependent)\b", _WORK],
     "L-2 dependent spouse employment authorized incident to status L-2S I-94 employment authorization EAD Form I-765 spouses of L-1 nonimmigrants", ["USCIS Policy Manual"]),
    ("l2_work_authorization", "general_info", [r"\bl[- ]?2s?\b", _WORK],
     "L-2 dependent spouse employment authorized incident to status L-2S I-94 employment authorization EAD Form I-765 spouses of L-1 nonimmigrants", ["USCIS Policy Manual"]),
]
# What an answer on a topic is told to say and to leave out.
GUIDANCE = {
    "nta_removal_high_risk": "Answer only for a person who has received a Notice to Appear (NTA) and is now in removal proceedings. Explain that the NTA initiates formal removal proceedings before immigration court/EOIR under 8 CFR 239.1. State clearly that not appearing in immigration court as required can result in an in absentia removal order. Strongly recommend consulting a qualified immigration attorney or BIA-accredited representative as soon as possible. Mention the right to be represented by counsel at no expense to the government. Do not mention DSO or school official — those roles are not relevant to removal proceedings. Do not advise on how to avoid appearing in immigration court. Do not discuss Form I-751 removal of conditions, naturalization, or unrelated topics unless directly asked.",
    "i485_advance_parole": "Answer only for a pending I-485 adjustment-of-status applicant asking about international travel. Explain that traveling abroad while an I-485 is pending without an approved advance parole document generally results in the I-485 being considered abandoned, under 8 CFR 245.2(a)(4)(ii). Mention Form I-131 as the form to apply for advance parole before departing. Note that certain exceptions may apply, such as some H-1B or L-1 status holders, but these are fact-specific. If recommending legal help, refer to a qualified immigration attorney or accredited representative only. Do not cite or discuss asylum travel limitations under 8 CFR 208.8 or 1208.8. Do not discuss special adjustment provisions under 8 CFR 1245.12 or 1245.13 unless directly asked. Do not discuss TPS travel authorization, parole-in-place, naturalization travel, Syria/special immigrant provisions, or T nonimmigrant travel unless directly asked.",
    "asylum_ead": "Answer only for pending asylum applicants seeking employment authorization under 8 CFR 208.7 and 274a.12(c)(8). Explain the 180-day waiting period: an applicant generally may not file Form I-765 for an EAD until 180 days after filing a complete asylum application. Mention that the EAD category for pending asylum applicants is (c)(8). Mention Form I-765 as the required form. Do not discuss adjustment-of-status EAD (c)(9), TPS, DACA, OPT, L-2, H-4, or LPR/Form I-551 employment authorization unless directly asked. Do not discuss Form I-589/asylum filing process unless directly asked.",
    "stem_opt": "Answer only for STEM OPT extension, the 24-month extension under 8 CFR 214.2(f)(10)(ii)(C). Explain that eligible F-1 students with a qualifying STEM degree on an initial OPT period may apply for a 24-month extension. Mention that the employer must be enrolled in E-Verify and the student must complete a Training Plan on Form I-983. Mention 8 CFR 274a.12(c)(3)(C) as the work authorization category for STEM OPT. Do not discuss CPT, pre-completion OPT, H-3 training, TN occupations, M-1/M-2 status, or unrelated categories unless directly asked.",
    "f1_cpt": "Answer only for F-1 CPT. Explain that CPT is authorized by the DSO on the student's I-20 under 8 CFR 214.2(f)(10)(i) and does not require USCIS approval or Form I-765. Mention that CPT must be an integral part of the established curriculum. Note that 12 or more months of full-time CPT eliminates OPT eligibility. Do not discuss post-completion OPT, STEM OPT extension, H-3 training, TN occupations, M-2 status, or unrelated categories unless directly asked.",
    "f1_opt": "Answer only for F-1 post-completion OPT. Explain that F-1 students may apply for up to 12 months of OPT in their field of study after completing their academic program. Mention that OPT requires DSO recommendation on the I-20, USCIS approval via Form I-765, and work authorization under 8 CFR 274a.12(c)(3). Do not discuss CPT, STEM OPT extension, pre-completion OPT, H-3 training, naturalization, adjustment of status, or unrelated categories unless directly asked.",
    "l2_work_authorization": "Answer only for L-2/L-2S spouse work authorization. Explain that certain L-2 spouses are employment authorized incident to status. Mention that the I-94 notation, such as L-2S, is important evidence of work authorization. Explain that Form I-765/EAD may be filed to obtain an EAD as evidence of identity and employment authorization, but avoid implying the EAD is always required for L-2S spouses. Do not discuss E-1, E-2, E-3 spouses unless directly asked. Do not mention H-4, I-140, AC21, naturalization, V visas, T visas, TPS, asylum, or unrelated categories.",
}
# Classes of a result for a topic, the first pattern that fits; otherwise it is neutral.
_CPT_KEEP = r"curriculum\s+practical\s+training|\bcpt\b|214\.2\s*\(\s*f\s*\)\s*\(\s*10\s*\)\s*\(\s*i\s*\)|\bDSO\b|integral\s+part\s+of\s+(?:the\s+)?established\s+curriculum|cooperative\s+education|required\s+internship|\bpracticum\b|\bI[- ]?20\b"
TOPIC_CLASSES = {
    "l2_work_authorization": [
        ("keep", r"\bL[- ]?2S?\b|\bL\s+spouses\b|\bE\s+and\s+L\s+spouses\b|\bL[- ]?2\s+nonimmigrant\s+dependent\s+spouses?\b|\bspouses\s+of\s+L[- ]?1\s+nonimmigrants\b|INA\s+214\(c\)\(2\)\(E\)|Vol\.?\s*10,?\s*Part\s*B,?\s*Ch\.?\s*2"),
        ("hard_reject", r"H[- ]?4|H[- ]?1B|approved\s+Form\s+I[- ]?140|AC21|J[- ]?2\s+nonimmigrants?|J[- ]?2\b|U[- ]?[2345]\b|U\s+nonimmigrant|Form\s+I[- ]?918|I[- ]?765V|Abused\s+Nonimmigrant\s+Spouse|U\.S\.\s+citizen\s+spouse|naturalization|regularly\s+stationed\s+abroad|I[- ]?751|V\s+nonimmigrant|lawful\s+permanent\s+residents?|T[- ]?1\s+nonimmigrant|T\s+nonimmigrant\s+derivative|O[- ]?3\s+dependent|CNMI\s+Investor|Temporary\s+Protected\s+Status|\bTPS\b|\basylum\b|adjustment\s+application"),
    ],
    "f1_opt": [
        ("hard_reject", r"214\.13|\bSEVIS\s+fee\b|no\s+new\s+fee|extension\s+of\s+stay,?\s+transfer|\bA-1\s+or\s+A-2\b|foreign\s+government\s+official|alien\s+spouse\s+or\s+unmarried\s+dependent\s+child|\bCNMI\b|Temporary\s+Protected\s+Status|\bTPS\b|274a\.12\s*\(\s*c\s*\)\s*\(\s*19\s*\)"),
        ("keep", r"optional\s+practical\s+training|post[- ]?completion\s+opt|\bopt\b|214\.2\s*\(\s*f\s*\)|274a\.12\s*\(\s*c\s*\)\s*\(\s*3\s*\)|f[- ]?1\s+(?:student|opt)"),
        ("soft_reject", r"curriculum\s+practical\s+training|\bcpt\b|stem\s+opt|24[- ]?month\s+extension|Form\s+I-983|\bH-3\b|\bM-2\b|\bTN\s+(?:visa|status|occupation)\b|adoption|214\.13"),
    ],
    "f1_cpt": [
        ("hard_reject", r"BIA\s+Precedent\s+Decisions|I&N\s+Dec\.|Board\s+of\s+Immigration\s+Appeals|\bImmigration\s+Judge\b|removal\s+proceedings|Notice\s+to\s+Appear|\bNTA\b"),
        ("keep", _CPT_KEEP),
        ("soft_reject", r"stem\s+opt|24[- ]?month\s+extension|Form\s+I-983|post[- ]?completion\s+opt|\bH-3\b|\bM-2\b|\bTN\s+(?:visa|status|occupation)\b|adoption|214\.13|\bSEVIS\s+fee\b"),
    ],
    "stem_opt": [
        ("hard_reject", r"Temporary\s+Protected\s+Status|\bTPS\b|274a\.12\s*\(\s*c\s*\)\s*\(\s*19\s*\)|\bSEVIS\s+fee\b|214\.13"),
        ("keep", r"stem\s+opt|24[- ]?month|Form\s+I-983|Training\s+Plan|E[- ]?Verify|214\.2\s*\(\s*f\s*\)\s*\(\s*10\s*\)\s*\(\s*ii\s*\)|274a\.12\s*\(\s*c\s*\)\s*\(\s*3\s*\)\s*\(\s*c\s*\)|STEM\s+degree"),
        ("soft_reject", r"curriculum\s+practical\s+training|\bcpt\b|\bH-3\b|\bM-1\b|\bM-2\b|\bTN\s+(?:visa|status|occupation)\b|adoption|214\.13"),
    ],
    "asylum_ead": [
        ("hard_reject", r"Form\s+I[- ]?551|\b1208\.3\b|274a\.12\s*\(\s*a\s*\)\s*\(\s*1\s*\)|\bI[- ]?751\b|274a\.12\s*\(\s*c\s*\)\s*\(\s*9\s*\)"),
        ("keep", r"\b208\.7\b|274a\.12\s*\(\s*c\s*\)\s*\(\s*8\s*\)|180[- ]?day|pending\s+asylum.{0,40}(?:ead|employment\s+authorization|work\s+authorization)|asylee.{0,50}(?:employment\s+authorization|ead|work\s+authorization)"),
        ("soft_reject", r"\bOPT\b|\bCPT\b|\bH[- ]?4\b|\bL[- ]?2\b|Temporary\s+Protected\s+Status|\bTPS\b|\bDACA\b|lawful\s+permanent\s+resident"),
    ],
    "i485_advance_parole": [
        ("hard_reject", r"\b208\.8\b|\b1208\.8\b|\b1245\.(?:7|10|12|13|19|20)\b|\b245\s*\(\s*i\s*\)|\bSupplement\s+A\b|\bPublic\s+Law\s+105[- ]?100\b|Foreign\s+Operations\s+Appropriations\s+Act|\bIndochinese\b.{0,60}\bparolee\b|\bSoviet\b.{0,60}\bparolee\b|\bSyrian?\b|\bT\s+nonimmigrant\b|\btrafficking\s+victim\b|claimed\s+persecution"),
        ("keep", r"\badvance\s+parole\b|\bForm\s+I[- ]?131\b|\bI[- ]?131\b|\babandonment\b|\btravel\s+document\b|\b245\.2\b"),
    ],
    "nta_removal_high_risk": [
        ("neutral", r"\b239\.|\b1239\.|notice\s+to\s+appear|removal\s+proceedings|immigration\s+court|\bEOIR\b|in\s+absentia|removal\s+defense|master\s+calendar"),
        ("hard_reject", r"\bI[- ]?751\b|\bconditional\s+(?:resident|permanent\s+resident)\b|\bremoval\s+of\s+conditions\b|\bVAWA\s+removal\s+of\s+conditions\b"),
    ],
}
STEM_SECTION, STEM_TERMS = r"\b274a\.13\b", r"stem\s+opt|I-983|E[- ]?Verify|24[- ]?month|214\.2\s*\(\s*f\s*\)\s*\(\s*10\s*\)\s*\(\s*ii\s*\)"
PAROLE_SECTION, PAROLE_TERMS = r"\b1245\.2\b", r"\bI[- ]?485\b|\badjustment\s+of\s+status\b|\badvance\s+parole\b|\babandonment\b"
FAMILY_BOOST = 0.004

# Conversation; turns, characters of a turn and of all, how questions start that need no context.
TURNS, TURN_CHARS, ALL_CHARS = 4, 400, 1600
STANDALONE = r"^(how do i|how can i|what is|what are|can i|do i|am i|should i)\b"
FOLLOW_UP = r"^(what about|what if|how about|and what|also[, ]|what is next|what's next|what happens next|what documents|which documents|which forms|what form|can i travel|what about travel)\b"
TOPIC_HINTS = {
    "opt": ["opt", "f-1", "f1", "stem", "214.2", "practical training"],
    "naturalization": ["naturalization", "n-400", "n400", "citizen", "citizenship"],
    "asylum": ["asylum", "refugee", "208.7", "i-589"],
    "ead": ["ead", "i-765", "765", "employment authorization", "work authorization"],
    "green_card": ["green card", "i-485", "adjustment of status", "permanent resident"],
    "nta": ["notice to appear", "nta", "removal", "immigration court"],
}
# English words that searches skip.
STOP_WORDS = "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
