"""Fixed values by which questions are taken in: queries for chosen categories, clarifications, patterns. All are matched whatever their case."""

from __future__ import annotations

# The query of a category that a user has chosen, or that a question's pattern stands for.
CATEGORY_QUERIES = {
    "asylum_pending": "Can asylum applicants get work authorization and apply for Form I-765 EAD 8 CFR 208.7 pending asylum",
    "adjustment_pending": "Employment authorization while adjustment of status Form I-485 is pending Form I-765 category c9",
    "f1_opt_stem_opt": "F-1 optional practical training OPT STEM OPT extension employment authorization Form I-765 8 CFR 214.2 217",
    "tps": "Temporary Protected Status TPS employment authorization Form I-765 8 CFR 244",
    "daca": "DACA deferred action employment authorization Form I-765 renewal",
    "ead_other": "Employment authorization categories Form I-765 8 CFR 274a.12",
    "asylum_eligibility": "Asylum application eligibility filing deadline Form I-589 8 CFR 208",
    "asylum_defensive": "Defensive asylum removal proceedings immigration judge Form I-589",
    "asylum_not_sure": "Asylum application overview eligibility 8 CFR 208 INA 208",
    "aos_family": "Adjustment of status family-based Form I-485 immediate relative",
    "aos_employment": "Adjustment of status employment-based Form I-485 priority date",
    "aos_other": "Adjustment of status eligibility Form I-485 requirements",
    "naturalization_residence": "Naturalization Form N-400 continuous residence physical presence good moral character",
    "naturalization_marriage": "Naturalization through marriage to U.S. citizen Form N-400 3 year residence",
    "naturalization_military": "Naturalization military service INA 328 329",
    "naturalization_other": "Naturalization eligibility Form N-400 requirements 8 CFR 316",
    "nta_court": "Notice to Appear removal proceedings immigration court 8 CFR 239 EOIR",
    "nta_attorney": "Notice to Appear right to counsel removal proceedings",
    "nta_not_sure": "Notice to Appear removal proceedings what happens next 8 CFR 239",
    "status_extend": "Extension of nonimmigrant status Form I-539 8 CFR 214",
    "status_change": "Change of nonimmigrant status Form I-539 eligibility 8 CFR 214",
    "status_not_sure": "Change or extension of status Form I-539 overview",
    "travel_aos": "Advance parole travel while adjustment of status I-485 pending Form I-131",
    "travel_pending_other": "Travel while immigration application pending advance parole 8 CFR 223",
    "travel_not_sure": "Advance parole travel authorization pending immigration case Form I-131",
    "family_immediate": "Form I-130 family petition immediate relative spouse parent child",
    "family_preference": "Form I-130 family preference categories F1 F2 F3 F4",
    "family_not_sure": "Form I-130 family-based immigration petition overview",
    "criminal_inadmissibility": "INA 212(a)(2) 8 U.S.C. 1182(a)(2) criminal grounds of inadmissibility crimes involving moral turpitude CIMT controlled substance violation multiple criminal convictions trafficking aggravated felony conviction inadmissibility bar",
    "criminal_deportability": "INA 237(a)(2) 8 U.S.C. 1227(a)(2) criminal grounds of deportability aggravated felony crimes involving moral turpitude controlled substance domestic violence firearms conviction removal deportation",
    "h4_process": "H-4 dependent nonimmigrant status spouse child of H-1B 8 CFR 214.2(h)(9)(iv) H-4 visa change of status extension of stay consular processing Form I-539",
    "h4_ead": "H-4 EAD employment authorization H-4 spouse 8 CFR 274a.12(c)(26) Form I-765 H-1B principal approved I-140 AC21 extension beyond six years H-4 dependent employment authorization document",
    "opt_general": "F-1 optional practical training OPT 8 CFR 214.2(f)(10) post-completion OPT pre-completion OPT Form I-765 8 CFR 274a.12(c)(3)",
}

# Topic, what is said, what is asked, (label, category) of the answers offered.
CLARIFICATIONS = [
    ("ead", "Employment authorization depends on your current immigration category.", "Which category best matches you?", [("Pending asylum", "asylum_pending"), ("Adjustment of status pending", "adjustment_pending"), ("F-1 OPT / STEM OPT", "f1_opt_stem_opt"), ("TPS", "tps"), ("DACA", "daca"), ("Other / not sure", "ead_other")]),
    ("asylum", "Asylum rules depend on whether you are applying affirmatively or in removal proceedings.", "Which situation best matches you?", [("Affirmative asylum (not in removal)", "asylum_eligibility"), ("In removal / immigration court", "asylum_defensive"), ("Not sure", "asylum_not_sure")]),
    ("aos", "Paths to a green card (lawful permanent residence) depend on how you qualify.", "Which path are you asking about?", [("Family-based green card", "aos_family"), ("Employment-based green card", "aos_employment"), ("Other / not sure", "aos_other")]),
    ("naturalization", "U.S. citizenship through naturalization depends on how you qualify.", "Which situation best matches you?", [("General naturalization (5 years)", "naturalization_residence"), ("Marriage to U.S. citizen (3 years)", "naturalization_marriage"), ("Military service", "naturalization_military"), ("Other / not sure", "naturalization_other")]),
    ("nta", "Next steps after a Notice to Appear depend on your court case and deadlines.", "What do you need help with?", [("What a Notice to Appear means", "nta_court"), ("Court hearing / deadlines", "nta_attorney"), ("Other / not sure", "nta_not_sure")]),
    ("status_change", "Changing or extending status depends on your current visa and what you want next.", "Which best matches you?", [("Extend current status", "status_extend"), ("Change to a different status", "status_change"), ("Not sure", "status_not_sure")]),
    ("travel", "Travel during a pending case depends on your application type and whether you have advance parole.", "Which situation best matches you?", [("I-485 adjustment of status pending", "travel_aos"), ("Other application pending", "travel_pending_other"), ("Not sure", "travel_not_sure")]),
    ("family_petition", "Family petitions depend on your relationship to the U.S. citizen or permanent resident sponsor.", "Which relationship category applies?", [("Immediate relative (spouse, parent, child)", "family_immediate"), ("Family preference category", "family_preference"), ("Not sure", "family_not_sure")]),
]

# Questions that are narrow enough to be answered at once.
SPECIFIC = [
    r"\basylum applicants?\b.*\b(work authorization|ead|employ)",
    r"\bcan asylum applicants?\b",
    r"\b(?:ead|i[- ]?765|work permit|employment authorization)\b.{0,100}\basylu",
    r"\bfiled (?:for )?asylum\b.{0,120}\b(?:ead|employment authorization|work authorization|work permit|i[- ]?765)\b",
    r"\bwhat is a notice to appear\b",
    r"\bwhat is an? rfe\b",
    r"\bwhat is (?:a )?form i-\d+",
    r"\bwhat is advance parole\b",
    r"\bcan tps holders?\b.*\b(work|ead|employ)",
    r"\bhow do i change my address with uscis\b",
    r"\boptional practical training\b.*\b(apply|eligib|work)",
    r"\bstem opt\b.*\b(apply|eligib|extension|work)",
    r"\b8 cfr\b",
    r"\b8 u\.s\.c\b",
    r"\bgood moral character\b.*\bnaturalization\b",
    r"\bcan i travel while i-485 is pending\b",
    r"\bcan i travel while .*adjustment of status\b",
    r"\bcan i travel while (?:my |the |a )?i[- ]?485\b",
    r"\btravel\b.{0,60}\bi[- ]?485\b.{0,60}\bpending\b",
    r"\brequirements? for naturalization\b",
    r"\bnaturalization requirements?\b",
    r"\bwhat (?:are|do i need).*\bnaturalization\b",
    r"\bhow (?:do i qualify|can i qualify) for naturalization\b",
    r"\beligib\w+ for naturalization\b",
]

# Broad topics that ask for a clarification, the first that fits.
BROAD = [
    ("ead", r"(\bhow do i apply for (?:an? )?ead\b|\bapply for employment authorization\b|\bget (?:an? )?ead\b|\bcan i work\b.*\b(?:u\.?s\.?|united states)\b|\bwork authorization\b(?!\s+(?:while|under|for)\s+(?:asylum|pending asylum)))"),
    ("asylum", r"(\bcan i apply for asylum\b|\bhow do i apply for asylum\b|\bshould i apply for asylum\b)(?!.*\bapplicants?\b)"),
    ("aos", r"(\bhow do i get (?:a )?green card\b|\bget (?:a )?green card\b|\blawful permanent resident\b.*\bhow\b|\badjustment of status\b.*\bhow do i\b)(?!.*\bi-485 is pending\b)"),
    ("naturalization", r"(\bhow do i become (?:a )?(?:u\.?s\.? )?citizen\b|\bhow do i get citizenship\b|\bbecome (?:a )?citizen\b)(?!.*\bgood moral character\b)"),
    ("nta", r"(\bwhat should i do after (?:receiving )?a notice to appear\b|\breceived a notice to appear\b.*\bwhat (?:now|should)\b)"),
    ("status_change", r"(\bcan i change my status\b|\bchange my immigration status\b|\bextend my status\b)(?!.*\bform i-539\b)"),
    ("travel", r"\bcan i travel while (?:my |a )?(?:case|application) is pending\b(?!.*\bi-485\b)"),
    ("family_petition", r"(\bhow do i (?:file|submit) (?:a )?form i-130\b|\bfamily petition\b.*\bhow\b)(?!.*\bwhat is form i-130\b)"),
]

# The category whose query a question stands for where no route fits, the first that fits.
_WORK = r"(?:ead|i[- ]?765|work permit|employment authorization|work authorization)"
_H4_WORK = r"(?:ead|employment\s+authorization|work\s+authorization|i[- ]?765)"
RESOLVED = [
    ("asylum_pending", rf"\basylu\w*\b.{{0,100}}\b{_WORK}\b|\b{_WORK}\b.{{0,100}}\basylu\w*\b|\bfiled (?:for )?asylum\b.{{0,120}}\b{_WORK}\b"),
    ("travel_aos", r"\bi[- ]?485\b.{0,80}\btravel\b|\btravel\b.{0,80}\bi[- ]?485\b|\badjustment of status\b.{0,80}\btravel\b|\btravel\b.{0,80}\badjustment of status\b"),
    ("h4_ead", rf"\bh[- ]?4\b.{{0,100}}\b{_H4_WORK}\b|\b{_H4_WORK}\b.{{0,100}}\bh[- ]?4\b|\bh[- ]?4\s+ead\b"),
    ("h4_process", r"\bh[- ]?4\b.{0,100}\b(?:process|visa|status|dependent|spouse|child|apply|eligib\w*|requirements?)\b|\b(?:what\s+is|how\s+does|how\s+do|explain)\b.{0,60}\bh[- ]?4\b|\bh[- ]?4\s+(?:visa|dependent|status|process|requirements?)\b|\bh[- ]?4\s+spouse\b|\bh[- ]?4\s+holder\b"),
    ("f1_opt_stem_opt", r"\bf[- ]?1\b.{0,100}\b(?:ead|work authorization|employment authorization|i[- ]?765)\b|\b(?:ead|work authorization|employment authorization|i[- ]?765)\b.{0,100}\bf[- ]?1\b|\bstem opt\b|\boptional practical training\b"),
    ("opt_general", r"\bwhat\s+is\b.{0,60}\bopt\b|\bopt\b.{0,80}\b(?:process|eligib\w*|requirements?|f[- ]?1|student|work|allow)\b|\boptional\s+practical\s+training\b|\bf[- ]?1\b.{0,60}\bopt\b|\bopt\b.{0,60}\bf[- ]?1\b|\bhow\s+(?:does|do)\b.{0,60}\bopt\b"),
    ("naturalization_residence", r"\brequirements? for naturalization\b|\bnaturalization requirements?\b|\bwhat (?:are|do i need).*\bnaturalization\b|\bhow (?:do i qualify|can i qualify) for naturalization\b|\beligib\w+ for naturalization\b"),
    ("criminal_deportability", r"\bcriminal\b.{0,40}\bdeportab\w+|\bdeportab\w+\b.{0,80}\b(?:criminal|crime|conviction|felony|misdemeanor)\b|\b(?:dui|dwi|conviction|criminal (?:charge|record|conviction)|felony|misdemeanor|crime)\b.{0,100}\b(?:deportab\w+|deported|deportation)\b|\bina\s*237\b|\b237\s*\(\s*a\s*\)\s*\(\s*2\s*\)"),
    ("criminal_inadmissibility", r"\bcriminal\b.{0,40}\binadmissib\w+|\binadmissib\w+\b.{0,80}\b(?:criminal|crime|conviction|dui|dwi|felony|misdemeanor)\b|\b(?:dui|dwi|conviction|criminal (?:charge|record|history|conviction)|felony|misdemeanor|crime|arrest)\b.{0,100}\b(?:affect|impact|bar|preclude|ineligible|inadmissible|prevent)\b.{0,80}\b(?:immigration|visa|green card|status|naturalization|admissibility)\b|\b(?:what|which)\s+crimes?\b.{0,80}\b(?:inadmissib\w+|ineligible|bar)\b|\bcrimes?\s+involving\s+moral\s+turpitude\b|\bcimt\b|\baggravated\s+felon\w+\b.{0,80}\b(?:immigration|inadmissib|visa|green card|naturalization)\b|\bina\s*212\b|\b212\s*\(\s*a\s*\)\s*\(\s*2\s*\)"),
]

# Questions that have prepared answers.
CRIMINAL_INFO = r"\bcriminal\b.{0,60}\b(?:inadmissib\w*|deportab\w*|grounds?|bar)\b|\b(?:dui|dwi|felony|misdemeanor|conviction|cimt)\b.{0,100}\b(?:immigration|visa|green\s*card|inadmissib\w*|deportab\w*|naturalization)\b|\bmoral\s+turpitude\b|\b212\s*\(\s*a\s*\)\s*\(\s*2\s*\)|\b237\s*\(\s*a\s*\)\s*\(\s*2\s*\)|\bcriminal\s+grounds?\b|\bcriminal\s+inadmissibility\b|\bcriminal\s+deportability\b|\binadmissib\w+.{0,80}\b(?:criminal|crime|felony|conviction|dui)\b|\bdeportab\w+.{0,80}\b(?:criminal|crime|felony|conviction|dui)\b|\b(?:what|which)\s+crimes?\b.{0,80}\b(?:inadmissib\w*|ineligible|bar|deportab\w*)\b"
DUI_INFO = r"\b(?:dui|dwi)\b.{0,100}\b(?:affect|impact|immigration|visa|green\s*card|inadmissib\w*|deportab\w*|naturalization|citizenship|removal|deportation|status|bar)\b|\b(?:immigration|visa|green\s*card|inadmissib\w*|deportab\w*|naturalization|citizenship|removal|deportation)\b.{0,100}\b(?:dui|dwi)\b"
H4_PROCESS_FAQ = r"\bwhat\s+is\b.{0,80}\bh[- ]?4\b|\bwhat\s+are\b.{0,80}\bh[- ]?4\b|\bhow\s+does\b.{0,80}\bh[- ]?4\b|\bexplain\b.{0,60}\bh[- ]?4\b|\bh[- ]?4\s+(?:visa\s+)?process\b|\bh[- ]?4\s+(?:visa|status|dependent)\b|\bwhat\s+are\s+the\s+(?:requirements?|eligib\w*)\s+for\s+(?:an?\s+)?h[- ]?4\b|\bhow\s+do\s+(?:i|you)\b.{0,80}\bh[- ]?4\b"
H4_EAD_FAQ = r"\bwhat\s+is\b.{0,80}\bh[- ]?4\b.{0,80}\b(?:ead|employment\s+authorization|work\s+authorization)\b|\bwhat\s+is\s+h[- ]?4\s+ead\b|\bhow\s+does\b.{0,80}\bh[- ]?4\b.{0,100}\b(?:ead|employment\s+authorization)\b|\bhow\s+does\b.{0,80}\b(?:ead|employment\s+authorization)\b.{0,80}\bh[- ]?4\b|\bh[- ]?4\s+ead\b|\bh[- ]?4\b.{0,80}\b(?:ead|employment\s+authorization)\b.{0,80}\b(?:requirements?|eligib\w*|process|overview)\b|\bcan\s+h[- ]?4\b.{0,80}\bwork\b|\bhow\s+do\b.{0,80}\bh[- ]?4\b.{0,80}\b(?:get|obtain)\b.{0,80}\b(?:ead|employment\s+authorization|work\s+authorization)\b|\bh[- ]?4\s+(?:employment|work)\s+authorization\b"
H4_OWN_CASE = r"\bmy\s+h[- ]?4\b|\bmy\s+(?:application|case|status|visa|petition)\b|\bh[- ]?4\b.{0,80}\b(?:denied|rejected|expired|rfe)\b|\b(?:denied|rejected)\b.{0,80}\bh[- ]?4\b|\bwhat\s+should\s+i\s+do\b|\bi\s+(?:was|have\s+been)\s+(?:denied|rejected)\b|\bhelp\s+(?:me|with)\s+my\b"

# What kind of answer a question asks for.
OWN_RISK = r"\bmy\s+(?:case|application|status|record|visa|petition|appeal|denial)\b|\bi\s+(?:was\s+denied|have\s+been\s+denied|was\s+arrested|have\s+an?\s+arrest\b|have\s+a\s+conviction\b|have\s+a\s+criminal\s+record\b|overstayed\b|am\s+detained\b)|\bprior\s+(?:denial|refusal|conviction|arrest)\b|\bunlawful\s+presence\b|\boverstay(?:ed|ing)?\b|\bcriminal\s+record\b|\bfraud\b|\bmisrepresent\w*\b"
DEFINING = r"^\s*(?:what\s+is\b|what\s+are\b|what\s+does\b|explain\b|define\b|how\s+is\b|tell\s+me\s+about\b)"
PROCESS = r"^\s*(?:how\s+do\s+i\b|how\s+does\b|how\s+can\s+i\b|how\s+would\s+i\b|how\s+to\b|what\s+are\s+the\s+steps\b|what\s+is\s+the\s+process\b)"

# How chunks of two sections are cited, whose text lost its parents' markers (section, start of the text, citation).
CANONICAL = [
    ("214.2", "(10) Practical training", "8 CFR § 214.2(f)(10)"),
    ("214.2", "(i) Curricular practical training", "8 CFR § 214.2(f)(10)(i)"),
    ("214.2", "(ii) Optional practical training", "8 CFR § 214.2(f)(10)(ii)"),
    ("214.2", "(iii) Internship with an international organization", "8 CFR § 214.2(f)(10)(iii)"),
    ("274a.12", "(iii) Curricular practical training", "8 CFR § 274a.12(b)(6)(iii)"),
]
