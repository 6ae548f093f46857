"""Word lists, lookup tables, constants and patterns.

The values below decide results and therefore have to be exactly these. Where
an operator takes the first entry that fits, the order of the entries counts.
"""

# --- code systems: name -> (uri, pattern); order decides ties
CODE_SYSTEMS = {
    "LOINC": ("http://loinc.org", r"^\d{1,5}-\d$"),
    "SNOMED": ("http://snomed.info/sct", r"^\d{6,18}$"),
    "ICD-10-CM": ("http://hl7.org/fhir/sid/icd-10-cm", r"^[A-TV-Z]\d{2}(\.[A-TV-Z0-9]{1,4})?$"),
    "ICD-10": ("http://hl7.org/fhir/sid/icd-10", r"^[A-Z]\d{2}(\.\d{1,2})?$"),
    "CPT": ("http://www.ama-assn.org/go/cpt", r"^\d{5}$"),
    "RxNorm": ("http://www.nlm.nih.gov/research/umls/rxnorm", r"^\d{1,8}$"),
    "UCUM": ("http://unitsofmeasure.org", r"^[a-zA-Z0-9/\[\]{}.*-]+$"),
}
UNKNOWN_SYSTEM_URI = "http://unknown.org"
CODE_CONTEXT_WORDS = {
    "LOINC": ["lab", "laboratory", "test", "observation", "vital"],
    "SNOMED": ["clinical", "assessment", "finding"],
    "ICD-10-CM": ["diagnosis", "condition", "disease", "disorder"],
    "ICD-10": ["diagnosis", "condition", "disease", "disorder"],
    "CPT": ["procedure", "surgery", "treatment", "service"],
    "RxNorm": ["medication", "drug", "prescription", "medicine"],
    "UCUM": ["unit", "measure", "quantity"],
}

# --- dates: formats in the order they are tried
DATE_FORMATS = [
    "yyyy-MM-dd", "M/d/yyyy", "M-d-yyyy", "d/M/yyyy", "d-M-yyyy",
    "MMMM d, yyyy", "MMM d, yyyy", "yyyy/M/d", "M/d/yy", "d/M/yy",
]

# --- laboratory codes by category
LOINC_CATEGORY = {
    "718-7": "Hematology",
    "789-8": "Hematology",
    "787-2": "Hematology",
    "785-6": "Hematology",
    "786-4": "Hematology",
    "788-0": "Hematology",
    "6690-2": "Hematology",
    "777-3": "Hematology",
    "4544-3": "Hematology",
    "26515-7": "Hematology",
    "2345-7": "Chemistry",
    "2160-0": "Chemistry",
    "3094-0": "Chemistry",
    "2951-2": "Chemistry",
    "2823-3": "Chemistry",
    "2075-0": "Chemistry",
    "2028-9": "Chemistry",
    "33914-3": "Chemistry",
    "1742-6": "Liver Function",
    "1920-8": "Liver Function",
    "6768-6": "Liver Function",
    "1975-2": "Liver Function",
    "2885-2": "Liver Function",
    "1751-7": "Liver Function",
    "2093-3": "Lipid Panel",
    "2571-8": "Lipid Panel",
    "2085-9": "Lipid Panel",
    "2089-1": "Lipid Panel",
    "13457-7": "Lipid Panel",
    "3016-3": "Thyroid",
    "3024-7": "Thyroid",
    "3053-6": "Thyroid",
    "4548-4": "Diabetes",
    "17856-6": "Diabetes",
    "5902-2": "Coagulation",
    "6301-6": "Coagulation",
    "3173-2": "Coagulation",
    "5804-0": "Urinalysis",
    "5811-5": "Urinalysis",
    "5803-2": "Urinalysis",
    "5794-3": "Urinalysis",
    "10839-9": "Cardiac",
    "33762-6": "Cardiac",
    "30934-4": "Cardiac",
    "2000-8": "Electrolytes",
    "2777-1": "Electrolytes",
    "2601-3": "Electrolytes",
}

# --- therapeutic classes; the first drug name contained decides
CLASS_OF_DRUG = [
    ("lisinopril", "ACE Inhibitors"), ("enalapril", "ACE Inhibitors"), ("ramipril", "ACE Inhibitors"),
    ("losartan", "ARBs"), ("valsartan", "ARBs"), ("olmesartan", "ARBs"),
    ("amlodipine", "Calcium Channel Blockers"), ("diltiazem", "Calcium Channel Blockers"),
    ("nifedipine", "Calcium Channel Blockers"),
    ("metoprolol", "Beta Blockers"), ("atenolol", "Beta Blockers"), ("carvedilol", "Beta Blockers"),
    ("atorvastatin", "Statins"), ("simvastatin", "Statins"), ("rosuvastatin", "Statins"),
    ("pravastatin", "Statins"),
    ("furosemide", "Diuretics"), ("hydrochlorothiazide", "Diuretics"), ("spironolactone", "Diuretics"),
    ("warfarin", "Anticoagulants"), ("apixaban", "Anticoagulants"), ("rivaroxaban", "Anticoagulants"),
    ("clopidogrel", "Antiplatelets"), ("aspirin", "Antiplatelets"),
    ("metformin", "Biguanides"), ("glipizide", "Sulfonylureas"), ("glyburide", "Sulfonylureas"),
    ("insulin", "Insulin"), ("lantus", "Insulin"), ("humalog", "Insulin"), ("novolog", "Insulin"),
    ("jardiance", "SGLT2 Inhibitors"), ("empagliflozin", "SGLT2 Inhibitors"),
    ("dapagliflozin", "SGLT2 Inhibitors"),
    ("victoza", "GLP-1 Agonists"), ("ozempic", "GLP-1 Agonists"), ("trulicity", "GLP-1 Agonists"),
    ("albuterol", "Bronchodilators"), ("levalbuterol", "Bronchodilators"),
    ("ipratropium", "Bronchodilators"),
    ("budesonide", "Inhaled Corticosteroids"), ("fluticasone", "Inhaled Corticosteroids"),
    ("montelukast", "Leukotriene Inhibitors"), ("prednisone", "Oral Corticosteroids"),
    ("omeprazole", "Proton Pump Inhibitors"), ("pantoprazole", "Proton Pump Inhibitors"),
    ("esomeprazole", "Proton Pump Inhibitors"), ("lansoprazole", "Proton Pump Inhibitors"),
    ("ranitidine", "H2 Blockers"), ("famotidine", "H2 Blockers"),
    ("amoxicillin", "Penicillins"), ("azithromycin", "Macrolides"),
    ("ciprofloxacin", "Fluoroquinolones"), ("levofloxacin", "Fluoroquinolones"),
    ("doxycycline", "Tetracyclines"), ("cephalexin", "Cephalosporins"),
    ("ibuprofen", "NSAIDs"), ("naproxen", "NSAIDs"), ("celecoxib", "NSAIDs"),
    ("acetaminophen", "Analgesics"), ("tramadol", "Opioids"), ("oxycodone", "Opioids"),
    ("hydrocodone", "Opioids"),
    ("sertraline", "SSRIs"), ("fluoxetine", "SSRIs"), ("escitalopram", "SSRIs"),
    ("citalopram", "SSRIs"), ("duloxetine", "SNRIs"), ("venlafaxine", "SNRIs"),
    ("bupropion", "Antidepressants"),
    ("alprazolam", "Benzodiazepines"), ("lorazepam", "Benzodiazepines"),
    ("clonazepam", "Benzodiazepines"),
    ("levothyroxine", "Thyroid Hormones"), ("synthroid", "Thyroid Hormones"),
    ("gabapentin", "Anticonvulsants"), ("pregabalin", "Anticonvulsants"),
    ("methotrexate", "Immunosuppressants"),
]

# --- observation categories
OBSERVATION_CODES = {
    "laboratory": "laboratory", "lab": "laboratory", "vital-signs": "vital_signs",
    "vital signs": "vital_signs", "vitals": "vital_signs", "exam": "exam",
    "social-history": "social_history", "social history": "social_history",
}
OBSERVATION_LABELS = [
    ("laboratory", "Labs"), ("vital_signs", "Vital Signs"),
    ("exam", "Physical Exam"), ("social_history", "Social History"),
]
SOCIAL_WORDS = [
    "smoking", "smoker", "tobacco", "cigarette", "nicotine", "vaping", "alcohol", "etoh",
    "substance use", "illicit", "drug use", "occupation", "employment", "marital status",
    "sexual history", "pack year", "pack-year", "recreational", "caffeine",
]
EXAM_WORDS = [
    "bmi", "body mass index", "body fat", "waist circumference", "physical exam", "inspection",
    "palpation", "auscultation", "gait", "general appearance", "edema", "murmur", "range of motion",
]
VITAL_WORDS = [
    "blood pressure", "systolic", "diastolic", "heart rate", "pulse", "respiratory rate",
    "respiration", "temperature", "body temperature", "oxygen saturation", "spo2", "o2 sat",
    "body weight", "weight", "height", "body height", "head circumference",
]

# --- encounters
ENCOUNTER_CODE_KIND = {
    "IMP": "inpatient", "ACUTE": "inpatient", "NONAC": "inpatient", "SS": "inpatient",
    "EMER": "emergency", "AMB": "ambulatory", "OBSENC": "ambulatory", "VR": "ambulatory",
    "HH": "ambulatory",
}
ENCOUNTER_KIND_LABELS = {
    "inpatient": "Inpatient Stay", "ambulatory": "Ambulatory Visit", "emergency": "Emergency Visit",
}
ENCOUNTER_KIND_WORDS = [
    ("emergency", ["emergency", "emergency room", "emergency department", "trauma"]),
    ("inpatient", ["inpatient", "admitted", "admission", "hospitalization", "hospitalisation",
                   "hospital stay", "discharge"]),
    ("ambulatory", ["outpatient", "office visit", "clinic", "ambulatory", "office", "consult",
                    "follow-up", "follow up"]),
]
TIMELINE_KIND_OF_CLASS = {
    "IMP": "admission", "ACUTE": "admission", "NONAC": "admission", "PRENC": "admission",
    "EMER": "emergency", "AMB": "consultation", "VR": "consultation",
    "OBSENC": "observation", "SS": "observation",
}
CLASS_DISPLAY = {
    "AMB": "Ambulatory", "EMER": "Emergency", "IMP": "Inpatient", "ACUTE": "Inpatient acute", "NONAC": "Inpatient non-acute",
    "OBSENC": "Observation", "PRENC": "Pre-admission", "SS": "Short stay", "VR": "Virtual",
}

# --- vaccines
VACCINE_WORDS = [
    "vaccine", "vaccination", "immunization", "immunisation", "toxoid", "influenza", "flu",
    "flu shot", "covid", "covid-19", "sars-cov-2", "tdap", "tetanus", "dtap", "mmr", "varicella",
    "hepatitis", "pneumococcal", "pneumovax", "prevnar", "shingrix", "shingles", "zoster", "hpv",
    "gardasil", "meningococcal", "polio", "rotavirus", "rsv", "booster",
]
CVX_SYSTEM = "http://hl7.org/fhir/sid/cvx"
CVX_BY_WORD = [
    ("influenza", "88", "Influenza, unspecified formulation"),
    ("flu", "88", "Influenza, unspecified formulation"),
    ("covid-19", "213", "SARS-COV-2 (COVID-19) vaccine, unspecified"),
    ("covid", "213", "SARS-COV-2 (COVID-19) vaccine, unspecified"),
    ("sars-cov-2", "213", "SARS-COV-2 (COVID-19) vaccine, unspecified"),
    ("tdap", "115", "Tdap"), ("dtap", "20", "DTaP"), ("td", "138", "Td (adult)"),
    ("tetanus", "112", "Tetanus toxoid, unspecified formulation"), ("mmr", "03", "MMR"),
    ("measles", "05", "Measles"), ("varicella", "21", "Varicella"),
    ("zoster", "187", "Zoster recombinant"), ("shingrix", "187", "Zoster recombinant"),
    ("shingles", "187", "Zoster recombinant"), ("hepatitis a", "52", "Hepatitis A, adult"),
    ("hepatitis b", "43", "Hepatitis B, adult"), ("hep b", "43", "Hepatitis B, adult"),
    ("hpv", "165", "HPV9"), ("gardasil", "165", "HPV9"),
    ("pneumococcal conjugate", "133", "Pneumococcal conjugate PCV 13"),
    ("prevnar", "133", "Pneumococcal conjugate PCV 13"),
    ("pneumococcal polysaccharide", "33", "Pneumococcal polysaccharide PPV23"),
    ("pneumovax", "33", "Pneumococcal polysaccharide PPV23"),
    ("pneumococcal", "109", "Pneumococcal, unspecified formulation"),
    ("meningococcal", "147", "Meningococcal MCV4, unspecified"), ("polio", "10", "IPV"),
    ("rsv", "305", "RSV, unspecified"), ("rotavirus", "122", "Rotavirus, unspecified formulation"),
    ("haemophilus", "17", "Hib, unspecified formulation"), ("hib", "17", "Hib, unspecified formulation"),
]

# --- labels of extracted fields: ordered (result, words) cascades
FIELD_CLASSES = [
    ("patient_demographics", ["name", "patient", "mrn", "ssn", "dob", "birth", "age", "gender", "address", "phone"]),
    ("diagnoses", ["diagnosis", "condition", "icd", "impression", "assessment", "chief complaint"]),
    ("medications", ["medication", "drug", "prescription", "dosage", "mg", "ml", "tablet", "capsule"]),
    ("lab_results", ["lab", "blood", "glucose", "hemoglobin", "cholesterol", "test", "result", "level"]),
    ("vital_signs", ["vital", "blood pressure", "bp", "heart rate", "temperature", "weight", "height"]),
    ("procedures", ["procedure", "surgery", "operation", "treatment", "therapy"]),
    ("allergies", ["allergy", "allergic", "reaction", "sensitivity"]),
    ("provider_info", ["doctor", "physician", "nurse", "provider", "practitioner"]),
    ("dates", ["date", "time", "on", "visit", "admission", "discharge"]),
]
DEMOGRAPHIC_LABELS = [
    ("patient_name", ["name", "patient"]), ("date_of_birth", ["dob", "birth", "born"]),
    ("medical_record_number", ["mrn", "medical record", "record number"]),
    ("gender", ["gender", "sex"]), ("age", ["age"]),
]
DATE_KINDS = [
    ("admission_date", ["admission", "admit"]), ("discharge_date", ["discharge"]),
    ("birth_date", ["birth", "dob"]), ("visit_date", ["visit", "appointment"]),
]
LAB_INDICATORS = ["glucose", "hemoglobin", "cholesterol", "sodium", "potassium", "creatinine"]
FIELD_IMPORTANCE = [
    (100, ["patient name", "mrn", "medical record"]),
    (90, ["dob", "birth", "age", "gender"]),
    (80, ["diagnosis", "condition", "chief complaint"]),
    (70, ["medication", "drug", "prescription"]),
    (60, ["lab", "blood", "vital", "pressure", "heart rate"]),
    (50, ["procedure", "surgery", "treatment"]),
    (40, ["doctor", "physician", "provider"]),
    (30, ["date", "time"]),
]
LABEL_PREFIX_CATEGORY = [
    ("diagnosis_", "conditions"), ("medication_", "medications"), ("vital_", "vital_signs"),
    ("lab_", "lab_results"), ("procedure_", "procedures"), ("provider_", "providers"),
]
COMPARISON_CATEGORIES = [
    ("demographics", ["name", "dob", "birth", "age", "gender", "sex", "race", "ethnicity"]),
    ("contact_info", ["phone", "email", "address", "contact", "emergency"]),
    ("medical_info", ["mrn", "insurance", "provider", "medical"]),
]
FIELD_RESOURCE = {
    "patient_name": ("Patient", "name"), "date_of_birth": ("Patient", "birthDate"),
    "medical_record_number": ("Patient", "identifier"), "sex": ("Patient", "gender"),
    "age": ("Patient", "extension"), "diagnoses": ("Condition", "code"),
    "procedures": ("Procedure", "code"), "medications": ("MedicationStatement", "medicationCodeableConcept"),
    "allergies": ("AllergyIntolerance", "substance"),
}
SERVICE_CATEGORIES = [
    (("394579002", "Cardiology"), ["cardiology", "cardiac", "heart"]),
    (("394591006", "Neurology"), ["neurology", "neuro", "brain"]),
    (("394801008", "Trauma and orthopedics"), ["orthopedic", "ortho", "bone", "joint"]),
    (("394582007", "Dermatology"), ["dermatology", "skin"]),
    (("394587001", "Psychiatry"), ["psychiatry", "mental health", "psychology"]),
    (("394595002", "Pathology"), ["lab", "laboratory", "blood", "test"]),
    (("394914008", "Radiology"), ["imaging", "x-ray", "ct", "mri", "ultrasound"]),
    (("394602003", "Rehabilitation"), ["physical therapy", "pt", "rehabilitation"]),
]
SERVICE_CATEGORY_DEFAULT = ("394658006", "Clinical specialty")
REPORT_CATEGORIES = [
    (("LAB", "Laboratory"), ["lab", "blood", "urine", "culture"]),
    (("RAD", "Radiology"), ["x-ray", "xray", "ct", "mri", "ultrasound", "imaging"]),
    (("CG", "Cardiodiagnostics"), ["ekg", "ecg", "cardio"]),
    (("PAT", "Pathology"), ["path", "biopsy"]),
]
REPORT_CATEGORY_DEFAULT = ("OTH", "Other")
DIAGNOSTIC_WORDS = [
    "lab", "test", "result", "ekg", "ecg", "x-ray", "xray", "imaging", "ultrasound", "ct scan",
    "mri", "blood test", "urine test", "culture", "biopsy", "pathology",
]

# --- body measures
BMI_BANDS = [
    ("underweight", 18.5, "Underweight"), ("normal", 25.0, "Normal Weight"),
    ("overweight", 30.0, "Overweight"), ("obese_class_1", 35.0, "Obese (Class I)"),
    ("obese_class_2", 40.0, "Obese (Class II)"),
]
BMI_TOP = ("obese_class_3", "Obese (Class III)")
KG_PER = {"kg": 1.0, "kilograms": 1.0, "lb": 0.453592, "lbs": 0.453592, "pounds": 0.453592}
M_PER = {"m": 1.0, "meters": 1.0, "in": 0.0254, "inches": 0.0254, "ft": 0.3048, "feet": 0.3048}

# --- prices per 1000 tokens (input, output), or per page
TOKEN_PRICES = {
    ("anthropic", "claude-3-opus-20240229"): ("0.015", "0.075"),
    ("anthropic", "claude-3-sonnet-20240229"): ("0.003", "0.015"),
    ("anthropic", "claude-3-haiku-20240307"): ("0.00025", "0.00125"),
    ("anthropic", "claude-sonnet-4-20250514"): ("0.006", "0.030"),
    ("anthropic", "claude-sonnet-4-5-20250929"): ("0.003", "0.015"),
    ("anthropic", "claude-3-opus"): ("0.015", "0.075"),
    ("anthropic", "claude-3-sonnet"): ("0.003", "0.015"),
    ("anthropic", "claude-3-haiku"): ("0.00025", "0.00125"),
    ("openai", "gpt-4"): ("0.03", "0.06"),
    ("openai", "gpt-4-turbo"): ("0.01", "0.03"),
    ("openai", "gpt-4-turbo-preview"): ("0.01", "0.03"),
    ("openai", "gpt-3.5-turbo"): ("0.0015", "0.002"),
    ("openai", "gpt-3.5-turbo-16k"): ("0.003", "0.004"),
}
PAGE_PRICES = {
    "detect_document_text": "0.0015", "detect": "0.0015", "start_document_text_detection": "0.0015",
    "analyze_document": "0.015", "analyze": "0.015", "start_document_analysis": "0.015",
}

# --- errors
ERROR_TYPE_CATEGORY = {
    "connection_error": "transient", "timeout": "transient", "server_overloaded": "transient",
    "network_error": "transient", "rate_limit_exceeded": "rate_limit",
    "rate_limit_error": "rate_limit", "too_many_requests": "rate_limit",
    "authentication_error": "authentication", "invalid_api_key": "authentication",
    "unauthorized": "authentication", "api_status_error": "permanent",
    "model_not_found": "permanent", "invalid_model": "permanent", "quota_exceeded": "permanent",
    "invalid_request": "malformed", "malformed_content": "malformed",
    "content_policy_violation": "malformed",
}
ERROR_MESSAGE_CATEGORY = [
    ("rate_limit", ["rate limit", "too many requests", "quota exceeded", "try again later", "retry after"]),
    ("transient", ["connection", "timeout", "network", "temporary", "temporarily unavailable", "server overloaded"]),
    ("authentication", ["auth", "key", "unauthorized", "forbidden"]),
    ("malformed", ["invalid", "malformed", "bad request"]),
]
ERROR_CODE_OF_TYPE = {
    "ConnectionError": "EXTERNAL_SERVICE_ERROR", "TimeoutError": "AI_SERVICE_TIMEOUT",
    "ValueError": "DATA_VALIDATION_ERROR", "KeyError": "CONFIGURATION_ERROR",
    "FileNotFoundError": "PDF_EXTRACTION_ERROR", "PermissionError": "PDF_EXTRACTION_ERROR",
}
RECOVERY_OF_CODE = {
    "AI_SERVICE_TIMEOUT": "retry_with_backoff", "AI_SERVICE_RATE_LIMIT": "wait_and_retry",
    "AI_RESPONSE_PARSING_ERROR": "fallback_extraction",
    "PDF_EXTRACTION_ERROR": "manual_review_required", "FHIR_VALIDATION_ERROR": "relaxed_validation",
    "PYDANTIC_MODEL_ERROR": "basic_extraction", "EXTERNAL_SERVICE_ERROR": "retry_or_skip",
}
ERROR_SEVERITY = {
    "AIServiceTimeoutError": "warning", "AIServiceRateLimitError": "warning",
    "PDFExtractionError": "error", "FHIRConversionError": "error",
    "AIExtractionError": "error", "CeleryTaskError": "error",
    "DocumentProcessingError": "critical",
}

# --- access log
PHI_EVENT_PATHS = ["/patients/", "/documents/", "/fhir/"]
PHI_PATHS = ["/patients/", "/documents/", "/fhir/", "/reports/"]
SENSITIVE_PATHS = [
    "/patients/", "/documents/", "/providers/", "/fhir/", "/reports/", "/admin/", "/api/", "/accounts/",
]

# --- text parsing patterns
MED_DOSAGE = [
    r"(\d+(?:\.\d+)?)\s*(mg|mcg|g|ml|units?|iu)\b",
    r"(\d+(?:\.\d+)?/\d+(?:\.\d+)?)\s*(mg|mcg|g|ml)\b",
    r"(\d+)\s*(tablet|capsule|pill)s?\b",
]
MED_ROUTE = [
    r"\b(oral|orally|po|by mouth)\b", r"\b(iv|intravenous|intravenously)\b",
    r"\b(im|intramuscular|intramuscularly)\b", r"\b(sc|sq|subcutaneous|subcutaneously)\b",
    r"\b(topical|topically)\b", r"\b(sublingual|sl)\b",
]
MED_SCHEDULE = [
    r"\b(with meals|after meals|before meals)\b", r"\b(as needed|prn|p\.r\.n\.)\b",
    r"\b(every \d+ hours?|q\d+h)\b", r"\b(four times daily|qid|q\.i\.d\.)\b",
    r"\b(three times daily|tid|t\.i\.d\.)\b", r"\b(twice daily|bid|b\.i\.d\.)\b",
    r"\b(once daily|daily|qd|q24h)\b",
]
DOSE_AMOUNT = r"(\d+\.?\d*\s*(mg|mcg|g|ml|units?|puffs?|tablets?|capsules?|iu)\b)"
DOSE_FREQUENCY = [
    (r"\b(once|twice|three times|four times)\s+(daily|a day|per day)\b", "{1} {2}"),
    (r"\bevery\s+(\d+)\s+(hour|hours|hr|hrs)\b", "every {1} {2}"),
    (r"\b(q\d+h)\b", "{1}"),
    (r"\b(as needed|prn|when necessary)\b", "as needed"),
    (r"\b(at bedtime|before bed|qhs)\b", "at bedtime"),
    (r"\b(in the morning|qam)\b", "in the morning"),
    (r"\b(with meals|with food)\b", "with meals"),
]
DOSE_ROUTES = [
    "oral", "sublingual", "topical", "intravenous", "intramuscular", "subcutaneous", "inhaled",
    "nasal", "ophthalmic", "otic", "rectal",
]
NAME_PREFIXES = ["dr", "dr.", "mr", "mr.", "mrs", "mrs.", "ms", "ms."]
NAME_SUFFIXES = ["jr", "jr.", "sr", "sr.", "ii", "iii", "iv"]
PROVIDER_TITLES = ["Dr.", "Dr", "Doctor", "Prof.", "Professor"]
PROVIDER_CREDENTIALS = ["M.D.", "MD", "D.O.", "DO", "R.N.", "RN", "PA", "NP", "PhD", "DDS"]

# --- capture metrics: category -> resource type
CATEGORY_RESOURCE = {
    "medications": "MedicationStatement", "diagnostic_reports": "DiagnosticReport",
    "diagnostics": "DiagnosticReport", "lab_results": "DiagnosticReport",
    "imaging_studies": "DiagnosticReport", "service_requests": "ServiceRequest",
    "referrals": "ServiceRequest", "consultations": "ServiceRequest", "encounter": "Encounter",
    "visit_information": "Encounter", "conditions": "Condition", "diagnoses": "Condition",
    "procedures": "Procedure", "vital_signs": "Observation", "observations": "Observation",
    "allergies": "AllergyIntolerance", "care_plans": "CarePlan", "treatment_plans": "CarePlan",
    "providers": "Practitioner", "organizations": "Organization",
}
COMPLETENESS_CATEGORIES = ["medications", "conditions", "diagnostic_reports"]

# --- lab panels: (name, code, minimum, words) in the order they are tried
LAB_PANELS = [
    ("Comprehensive Metabolic Panel", "24323-8", 8, [
        "glucose", "bun", "creatinine", "sodium", "potassium", "chloride", "co2", "carbon dioxide",
        "calcium", "albumin", "bilirubin", "alkaline phosphatase", "ast", "alt", "total protein", "egfr"]),
    ("Basic Metabolic Panel", "24321-2", 6, [
        "glucose", "bun", "creatinine", "sodium", "potassium", "chloride", "co2", "carbon dioxide",
        "calcium", "egfr"]),
    ("CBC with Differential", "57021-8", 6, [
        "wbc", "rbc", "hemoglobin", "hematocrit", "platelet", "neutrophil", "lymphocyte", "monocyte",
        "eosinophil", "basophil", "mcv", "mch", "mchc", "rdw"]),
    ("Lipid Panel", "24331-1", 3, ["cholesterol", "hdl", "ldl", "triglyceride", "vldl"]),
    ("NMR LipoProfile", "63550-2", 2, ["ldl-p", "hdl-p", "small ldl", "lp-ir", "ldl size"]),
    ("Hemoglobin A1C", "4548-4", 1, ["a1c", "hba1c", "hemoglobin a1c", "glycated"]),
    ("Thyroid Panel", "24348-5", 1, ["tsh", "free t4", "free t3", "t4", "t3", "thyroid"]),
    ("PSA", "2857-1", 1, ["psa", "prostate specific antigen"]),
]
OTHER_PANEL = "Miscellaneous Lab Results"

# --- operations
LIVE_STATUSES = ["pending", "ocr_pending", "processing"]
DOCUMENT_COST_LIMIT = "5.00"
DAILY_COST_LIMIT = "100.00"
PARTIAL_THRESHOLD = 0.85
MEDICATION_STATUS_ORDER = {
    "active": 0, "intended": 1, "completed": 2, "on-hold": 3, "stopped": 4, "unknown": 5, "entered-in-error": 6,
}

# --- section markers and words that open a section
SECTION_MARKERS = {
    "patient_info_sections": [
        r"(?i)patient\s+information|demographics|patient\s+data", r"(?i)name:|dob:|mrn:|medical\s+record",
        r"(?i)address:|phone:|contact\s+info"],
    "diagnosis_sections": [
        r"(?i)diagnosis|diagnoses|impression|assessment", r"(?i)chief\s+complaint|cc:|presenting\s+problem",
        r"(?i)final\s+diagnosis|working\s+diagnosis"],
    "medication_sections": [
        r"(?i)medications|current\s+meds|prescriptions", r"(?i)drug\s+list|medication\s+list|pharmacy",
        r"(?i)dosage:|frequency:|route:"],
    "procedure_sections": [
        r"(?i)procedures|operations|surgery", r"(?i)procedure\s+note|operative\s+report",
        r"(?i)treatment\s+plan|interventions"],
    "lab_sections": [
        r"(?i)laboratory|lab\s+results|pathology", r"(?i)blood\s+work|culture|specimen",
        r"(?i)normal\s+range|reference\s+range"],
    "major_section_breaks": [r"\n\s*\n\s*\n"],
    "page_breaks": [r"(?i)page\s+\d+|--- page \d+ ---|new\s+page"],
    "paragraph_breaks": [r"\n\s*\n"],
}
SIGNIFICANT_WORDS = (
    r"(?i)section|chapter|part|summary|conclusion|patient|diagnosis|medication|procedure|lab|report|note|record|document"
)

# --- date families (pattern, shape, confidence); slash dates are month first
DATE_FAMILIES = [
    (r"\b(\d{1,2})/(\d{1,2})/(\d{2,4})\b", "mdy", 0.85),
    (r"\b(\d{4})-(\d{2})-(\d{2})\b", "ymd", 0.95),
    (r"\b(\d{1,2})-(\d{1,2})-(\d{2,4})\b", "mdy", 0.80),
    (r"\b(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+(\d{1,2}),?\s+(\d{4})\b", "bdy", 0.90),
    (r"\b(\d{1,2})\s+(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+(\d{4})\b", "dby", 0.85),
    (r"\b(\d{1,2})\.(\d{1,2})\.(\d{2,4})\b", "mdy", 0.75),
]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
PATIENT_FIELDS = {
    "patientName": (0.8, [
        r"Patient:?\s*([A-Z][a-z]+,\s*[A-Z][a-z\s]+)", r"Name:?\s*([A-Z][a-z]+,\s*[A-Z][a-z\s]+)", r"patient\s+([A-Z][a-z]+,\s*[A-Z][a-z\s]+)", r"for patient\s+([A-Z][a-z]+,\s*[A-Z][a-z\s]+)",
        r"([A-Z][A-Z\s]+,\s*[A-Z][A-Z\s]+)"]),
    "dateOfBirth": (0.9, [r"DOB:?\s*(\d{1,2}/\d{1,2}/\d{4})", r"Date of Birth:?\s*(\d{1,2}/\d{1,2}/\d{4})", r"Born:?\s*(\d{1,2}/\d{1,2}/\d{4})", r"was born on\s*(\d{1,2}/\d{1,2}/\d{4})", r"birth date:?\s*(\d{1,2}/\d{1,2}/\d{4})"]),
    "sex": (0.9, [r"(?i)Sex:?\s*(Male|Female|M|F)", r"(?i)Gender:?\s*(Male|Female|M|F)", r"(?i)Patient gender is\s*(Male|Female|M|F)", r"(?i)gender\s+is\s*(Male|Female|M|F)"]),
    "age": (0.8, [r"(?i)Age:?\s*(\d+)\s*(?:years?|y\.?o\.?)", r"(?i)(\d+)\s*(?:year old|years old|yo)"]),
    "medicalRecordNumber": (0.9, [r"MR#:?\s*(\d+)", r"MRN:?\s*(\d+)", r"Medical Record:?\s*(\d+)", r"MRN\s+(\d+)\s+was assigned", r"record number:?\s*(\d+)"]),
}
FALLBACK_FIELDS = {
    "patient_name": [r"(?:Patient|Name|PATIENT):\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)", r"(?:Name|NAME):\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)", r"([A-Z][a-z]+,\s*[A-Z][a-z]+)"],
    "medical_record_number": [r"(?i)(?:MRN|Medical Record|Record Number):\s*([A-Z0-9]+)", r"(?i)(?:MRN|MR#):\s*([A-Z0-9]+)", r"(?i)(?:ID|Patient ID):\s*([A-Z0-9]+)"],
    "date_of_birth": [r"(?:Date of Birth|DOB|Born):\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})", r"(\d{1,2}[/-]\d{1,2}[/-]\d{4})"],
    "primary_diagnosis": [r"(?:Diagnosis|DIAGNOSIS|Primary Diagnosis):\s*([^\n\r]+)", r"(?:Impression|IMPRESSION):\s*([^\n\r]+)"],
}
FALLBACK_MEDICATION = [r"(?i)\b\w+\s+\d+\s*mg\b", r"(?i)\b\w+\s+\d+\s*mcg\b", r"(?i)\b\w+\s+\d+\s*units?\b"]
FALLBACK_DIAGNOSIS = [r"(?i)(?:diagnosis|dx|impression):\s*([^.\n]+)", r"(?i)(?:condition|disease):\s*([^.\n]+)"]
MEDICATION_LINES = [r"Medications?:?\s*([^\n]+)", r"Current Medications?:?\s*([^\n]+)"]
ALLERGY_LINES = [r"(?i)ALLERG(?:Y|IES)(?:\s+LIST)?:?\s*([^\n]+)", r"(?i)Known Allergies:?\s*([^\n]+)", r"(?i)Drug Allergies:?\s*([^\n]+)"]
PROCEDURE_PATTERNS = [
    r"(EKG|ECG|electrocardiogram)", r"(chest x-ray|chest xray|CXR)", r"(CT scan|computed tomography)", r"(MRI|magnetic resonance)",
    r"(ultrasound|US|echo)", r"(blood test|lab work|laboratory)", r"(urine test|urinalysis|UA)", r"(culture|blood culture)",
    r"(biopsy|pathology)", r"([A-Z][a-z]+ test)",
]
REPORT_DATES = [r"(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})", r"(\d{4}-\d{2}-\d{2})"]
CONCLUSIONS = [r"result[s]?[:\s]+(.+)", r"conclusion[:\s]+(.+)", r"finding[s]?[:\s]+(.+)", r"impression[:\s]+(.+)", r"shows?[:\s]+(.+)", r"reveals?[:\s]+(.+)"]
SERVICE_PATTERNS = [
    r"(cardiology|neurology|orthopedic|dermatology|psychiatry|psychology)\s*(?:consult|consultation)", r"(?:refer|referral)\s+to\s+([^.]+)",
    r"(?:consult|consultation)\s+with\s+([^.]+)", r"(?:order|obtain)\s+([^.]+)", r"follow[- ]?up\s+with\s+([^.]+)", r"see\s+([^.]+)",
]
SERVICE_DATES = [r"(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})", r"(\d{4}-\d{2}-\d{2})", r"(in \d+ weeks?)", r"(in \d+ months?)", r"(next week|next month)", r"(asap|urgent|stat)"]
SERVICE_REASONS = [r"for\s+([^.]+)", r"due to\s+([^.]+)", r"because of\s+([^.]+)", r"indication[:\s]+([^.]+)"]
PLAN_VERBS = [r"refer to ([^.]+)", r"consult with ([^.]+)", r"order ([^.]+)", r"schedule ([^.]+)", r"follow[- ]?up with ([^.]+)", r"see ([^.]+)", r"obtain ([^.]+)"]
