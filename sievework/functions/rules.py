"""Word lists and patterns that results depend on.  They are data; what uses them is elsewhere."""

#: Fixed values.  Patterns on normalised text; any of them disqualifies, the first names the rule.
DISQUALIFIERS = (
    r"\b(us|u s)?\s*citizenship\s*:?\s*(is\s+)?(required|requirement)\b",
    r"\bcitizenship\s*:\s*this\s+position\s+requires\b",
    r"\brequires?\s+(us\s+|u s\s+)?citizenship\b",
    r"\bwill\s+require\s+(us\s+|u s\s+)?citizenship\b",
    r"\bmust\s+be\s+a?\s*(us|u s)?\s*citizen\b",
    r"\b(us|u s)\s+citizens?\s+only\b",
    r"\bonly\s+(us|u s)\s+citizens?\b",
    r"\bcitizens?\s+(are\s+)?required\b",
    r"\bsecurity\s+clearance\s+(is\s+)?(required|requirement)\b",
    r"\b(require|requires|will require|must have|must possess|must hold|must obtain)\s+(an?\s+)?(active\s+|current\s+)?(security\s+)?clearance\b",
    r"\bactive\s+(security\s+)?clearance\b",
    r"\bclearance\s+required\s*:?\s*(active|public|secret|top)\b",
    r"\bclearance\s*:\s*(active\s+|current\s+|ability to obtain\s+|able to obtain\s+)?(a\s+)?(top[\s-]?secret|secret|public\s+trust|ts\/sci|ts-sci|ts\s+sci)\b",
    r"\bclearance\s+required\b",
    r"\bpublic\s+trust\s+(clearance|required)\b",
    r"\b(ability to obtain|must be able to obtain|eligible to obtain|able to obtain)\s+(a\s+)?(public\s+trust|security|secret|ts\/sci)?\s*clearance\b",
    r"\bactive\s+(top[\s-]?secret|public\s+trust|ts\/sci)\b",
    r"\b(requires?|must have|must hold|must possess)\s+(a\s+|an\s+)?(active\s+|current\s+)?(public\s+trust|top[\s-]?secret|ts\/sci)\b",
    r"\btop\s+secret\b",
    r"\bts\/sci\b",
    r"\bts\s+sci\b",
    r"\bts-sci\b",
    r"\bsecret\s+clearance\b",
    r"\bdod\s+clearance\b",
    r"\bsecurity\s+clearance\b",
    r"\b(obtain|maintain|hold|possess|acquire|eligible|able|ability|require|requires|required)\b[^.]{0,40}\bsecurity\s+clearance\b",
    r"\b(obtain|maintain)\b[^.]{0,30}\bclearance\b",
    r"\bsecurity\s+clearance\b[^.]{0,40}\b(required|is required|must|eligib)",
    r"\b\(clearance\s+required\)",
    r"\bclearance\b.{0,20}\bus\s+citizen\b",
    r"\bus\s+citizen\b.{0,20}\bclearance\b",
    r"\bno\s+(visa\s+)?sponsorship\b",
    r"\bno\s+(new\s+|additional\s+|further\s+|current\s+|future\s+|ongoing\s+|employer\s+|employment\s+|work\s+|immigration\s+|us\s+|u\.s\.\s+|h-?1b\s+|h1-?b\s+|green\s+card\s+|visa\s+)+sponsorship\b",
    r"\b(does|do|will|would|can|shall)\s+not\s+include\s+(any\s+|visa\s+|work\s+|employment\s+|immigration\s+|us\s+|u\.s\.\s+)*sponsorship\b",
    r"\b(will\s+not|cannot|can not|unable to|not able to|does not|do not|won't|are not able to|is not able to)\s+(offer|provide|sponsor)\b",
    r"\b(unable|not able)\s+to\s+(offer|provide)\s+(work\s+)?(visa\s+)?sponsorship\b",
    r"\b(does|do)\s+not\s+(offer|provide)\s+(work\s+)?(visa\s+)?sponsorship\b",
    r"\b(is\s+)?not\s+open\s+to\s+(visa\s+)?sponsorship\b",
    r"\bsponsorship\s*:?\s*(is\s+)?not\s+(available|offered|provided)\b",
    r"\bsponsorship\s+not\s+available\b",
    r"\b(visa\s+|work\s+|employment\s+|immigration\s+)?sponsorship\b[^.!?;]{0,75}?\b(is|are|will|would|can|shall)\s+not\s+(be\s+)?(provided|offered|available|supported|considered|granted)\b",
    r"\b(visa\s+)?sponsorship\s+(is\s+)?(not\s+available|unavailable)\b",
    r"\bwithout\s+(employer\s+)?sponsorship\b",
    r"\bmust\s+be\s+(legally\s+|lawfully\s+)?authorized\s+to\s+work\b[^.]{0,40}\bwithout\b",
    r"\bnot\s+eligible\s+for\s+([\w-]+\s+){0,5}sponsorship\b",
    r"\bineligible\s+for\s+(\w+\s+){0,3}sponsorship\b",
    r"\bno\s+h-?1b\s+or\s+opt\s+(visa\s+)?sponsorship\b",
    r"\bregret\s+that\s+we\s+are\s+unable\s+to\s+(offer|provide)",
    r"\bgreen\s+card\s+(is\s+)?required\b",
    r"\bgc\s+required\b",
    r"\bpermanent\s+resident\s+(is\s+)?required\b",
    r"\bmust\s+be\s+(us\s+|u s\s+|united states\s+)?citizens?\b",
    r"\bcitizens?\s+or\s+(lawful\s+)?permanent\s+residents?\b",
    r"\bpermanent\s+residents?\s+or\s+citizens?\b",
    r"\b(must\s+not|not|does\s+not|will\s+not|cannot|can not)\s+require\s+(visa\s+)?sponsorship\b",
    r"\bsponsorship\s+(now\s+or\s+in\s+the\s+future|in\s+the\s+future)\b",
    r"\bmust\s+be\s+a?\s*(lawful\s+)?permanent\s+residents?\b",
    r"\bdoes\s+not\s+(now\s+(and|or)\s+in\s+the\s+future\s+)?require\s+(the\s+)?sponsorship\b",
    r"\bwill\s+not\s+require\s+(visa\s+|immigration\s+|employer\s+)?sponsorship\b",
    r"\b(u\.?\s?s\.?|united\s+states|american)\s+citizens?\b(?!\s*(status|hip))",
    r"\b(top\s+secret|ts\/?sci|ts|sci|secret|confidential)\b[^.]{0,25}\bclearance\b",
    r"\bclearance\b[^.]{0,25}\b(sci|ts\/?sci|top\s+secret|polygraph)\b",
    r"\b(can\s?not|cannot|will\s+not|unable\s+to|do(es)?\s+not)\b[^.]{0,60}\bor\s+sponsor\b",
    r"\b(do(es)?\s+not|will\s+not|cannot|can\s?not|are\s+not|is\s+not)\s+(currently\s+|presently\s+|at\s+this\s+time\s+)?sponsor\b",
    r"\bno\s+(current\s+(or|and)\s+future\s+|future\s+|ongoing\s+)?sponsorship\s+(need|requirement)",
    r"\bu\.?\s?s\.?\s+person\b\s*[;,:]?\s*(clearance|security|itar|eligib)",
    r"\bclearance\s+eligib\w+",
    r"\b(not\s+(\w+\s+){0,3}able\s+to|cannot|can\s?not|unable\s+to|do(es)?\s+not|will\s+not)\s+(consider|accept|hire|employ|entertain|review)\b[^.]{0,80}\b(require|requiring|need|needing|request)\w*\s+(visa\s+|immigration\s+|employer\s+|work\s+)?sponsorship\b",
    r"\b(requir\w+|need\w+)\s+(visa\s+|immigration\s+|employer\s+|work\s+)?sponsorship\b[^.]{0,60}\b(will\s+not|cannot|can\s?not)\s+be\s+(considered|accepted|hired|employed)\b",
    r"\bsubject\s+to\s+(u\.?\s?s\.?\s+|united\s+states\s+|american\s+)?export\s+control",
    r"\baccess\b[^.]{0,60}\bexport\s+control",
    r"\bu\.?\s?s\.?\s+person(s)?\s+(status|requirement|only|eligibility)\b",
    r"\b(be|being|is)\s+an?\s+(u\.?\s?s\.?|united\s+states|american)\s+citizens?\b",
    r"\b(u\.?\s?s\.?|united\s+states|american)\s+citizens?\s+(and|or|\/)\s*(lawful\s+)?(permanent\s+residents?|green\s+card\s+holders?)\b",
    r"\b(authoriz\w+|eligible|legally\s+entitled|permitted)\b[^.]{0,100}\bwithout\b[^.]{0,60}\bsponsorship\b",
    r"\bnot\s+(\w+\s+){0,3}able\s+to\s+(offer|provide|sponsor|support|extend|assist\s+with)\b",
    r"\b(eligible|authoriz\w+|permitted|right)\s+to\s+work\s+in\s+(?!the\s+us|the\s+united\s+states|us\b|usa\b)(the\s+)?(uk|eu|united\s+kingdom|germany|france|spain|italy|netherlands|ireland|poland|portugal|sweden|canada|india|australia|singapore|japan|brazil|mexico|switzerland|belgium|austria|denmark|norway|finland|romania|ukraine|israel|turkey|czech)\b",
    r"\bno\s+(h-?1b|opt|cpt|f-?1|tn|e-?3|visa|immigration|employment|work)\b[^.]{0,60}\bsponsorship\b",
    r"\bskillbridge\b",
    r"\b(currently\s+)?serving\s+on\s+active\s+duty\b",
    r"\b(u\s?s|u\.s\.|united states|american)\s+citizenship\b(?!\s+status)",
    r"\bpublic\s+trust\b[^.]{0,60}\b(position|clearance|eligib|determination|investigation|background|suitability|required)",
    r"\b(obtain|maintain|hold|eligible\s+for|able\s+to\s+obtain)\b[^.]{0,40}\bpublic\s+trust\b",
    r"\bpolygraph\b",
    r"\bwork\s+authorization\s+related\s+to\s+(certain\s+)?(us|u s|united states)?\s*visa\s+categor",
    r"\b(will\s+not|cannot|can\s?not|unable\s+to|not\s+able\s+to|does\s+not|do\s+not|won'?t|are\s+not\s+able\s+to|is\s+not\s+able\s+to|not\s+be\s+able\s+to|may\s+not\s+be\s+able\s+to)\s+support\s+(work\s+|visa\s+|h-?1b\s+|immigration\s+|future\s+)*sponsorships?\b",
    r"\bwithout\s+(the\s+need\s+(for\s+)?|requiring\s+|current\s+or\s+future\s+|any\s+)*(employer[\s-]?sponsored\s+|employer\s+|company\s+|visa\s+|immigration\s+|work\s+)+sponsorship\b",
    r"\bmust\s+be\s+a?\s*(us|united states)\s+persons?\b",
    r"\b(us|united states)\s+persons?\s+(status\s+)?(is\s+)?(required|only)\b",
    r"\b(restricted|limited)\s+to\s+(us|united states)\s+persons?\b",
    r"\bitar\b",
    r"\bear\s+controlled\b",
    r"\bexport\s+administration\s+regulations\b",
    r"\bexport[\s-]?control(led)?\s+(information|data|technology|technical data|materials?|items?|regulations?|requirements?|laws?|restrictions?|facilit)",
    r"\baccess\s+to\s+export[\s-]?controlled\b",
    r"\bsubject\s+to\s+(itar|ear|export[\s-]?control)",
)

#: Fixed values.  Phrases after which no weaker contract sign counts.
CONTRACT_EXCEPTIONS = (
    r"\bsmart\s+contract",
    r"\bgovernment\s+contracts?\b",
    r"\bcontract\s+negotiations?\b",
    r"\bcontract\s+law\b",
    r"\bcontract\s+review\b",
    r"\bmanag(e|ing)\s+contracts?\b",
    r"\bdrafting\s+contracts?\b",
    r"\bcontract\s+management\b",
    r"\bcontract\s+compliance\b",
    r"\b(roofing|general|licensed|preferred|certified)\s+contractors?\b",
)

#: Fixed values.  (pattern, category) in order of precedence, on padded lower-case titles.
CATEGORY_RULES = (
    (r"\b(software|data|devops|security|cloud|platform|systems|network|backend|frontend|full ?stack|machine learning|ml|ai|qa|test|automation|release|build|integration|identity|infrastructure|reliability|solutions|support|application)\s+(engineer|developer|architect)\b", "Tech"),
    (r"\b(engineer|developer|architect)\s+(software|data|devops|security|cloud|platform|systems|network|backend|frontend)\b", "Tech"),
    (r"\b(software engineer|data scientist|data engineer|web developer|mobile developer|site reliability)\b", "Tech"),
    (r"\b(sales (director|manager|representative|lead|specialist)|account executive|business development (manager|representative))\b", "Sales & Marketing"),
    (r"\b(financial analyst|finance (specialist|manager|director|analyst)|staff accountant|senior accountant|accounts (payable|receivable))\b", "Finance & Accounting"),
    (r"\b(technical recruiter|recruiting (manager|coordinator)|talent acquisition)\b", "HR & Operations"),
    (r"\b(nurse|nursing|rn|lpn|lvn|cna|bsn|np|crna)\b", "Healthcare"),
    (r"\b(physician|surgeon|surgical|doctor|md|dds|dmd|dentist|endodontist|orthodontist|periodontist|hygienist)\b", "Healthcare"),
    (r"\b(pharmacist|pharmacy|pharmac)\w*", "Healthcare"),
    (r"\b(veterinar\w*|vet tech|kennel)\b", "Healthcare"),
    (r"\b(therapist|therapy|physical therap|occupational therap|speech language|pathologist|cota|pta)\b", "Healthcare"),
    (r"\b(bcba|behavior analyst|behavioral health|autism|aba)\b", "Healthcare"),
    (r"\b(clinical|clinician|patient|hospice|caregiver|care giver|direct support professional|direct care|home health|health aide|phlebotom\w*|radiolog\w*|sonograph\w*|medical assistant|medical receptionist|medical director|medical science|dietitian|nutritionist|paramedic|emt)\b", "Healthcare"),
    (r"\b(counselor|social worker|case manager|case management|health coach|health navigator|community liaison|intervention specialist|personal care)\b", "Healthcare"),
    (r"\b(attorney|counsel|litigation|paralegal|solicitor|barrister|legal|law clerk|presuit|court)\b", "Legal"),
    (r"\b(teacher|teaching|instructor|professor|tutor|faculty|principal of|educator|instructional aide|admissions representative|substitute)\b", "Education"),
    (r"\b(electrician|plumber|hvac|welder|machinist|carpenter|mason|roofer|painter|installer|foreman|superintendent|groundskeeper|landscap\w*|janitor|custodian|housekeep\w*|driver|cdl|dispatcher|warehouse|material handler|forklift|assembler|line cook|chef|server|bartender|barista|cashier|stylist|tailor|barber|personal trainer|security officer|guard)\b", "Skilled trades"),
    (r"\b(civil|mechanical|electrical|structural|chemical|aerospace|aeronautic\w*|manufacturing|industrial|process|environmental|geotechnical|petroleum|mining|nuclear|biomedical|materials|optical|acoustic|marine)\s+engineer", "Engineering & Science"),
    (r"\b(engineer\w*)\s+(civil|mechanical|electrical|structural|chemical|aerospace|manufacturing|industrial)\b", "Engineering & Science"),
    (r"\b(biologist|chemist|physicist|geologist|microbiolog\w*|laborator\w*|lab technician|research associate|clinical research|r&d|formulation|metallurg\w*|surveyor|drafter|cad)\b", "Engineering & Science"),
    (r"\b(software|developer|programmer|coder|swe|sde)\b", "Tech"),
    (r"\b(back ?end|front ?end|full ?stack|web dev|mobile dev|ios|android|embedded|firmware)\b", "Tech"),
    (r"\b(devops|sre|site reliability|platform engineer|infrastructure|systems engineer|network engineer|cloud|kubernetes|reliability engineer)\b", "Tech"),
    (r"\b(data engineer|data scientist|data analyst|data architect|analytics engineer|machine learning|deep learning|ml|ai|artificial intelligence|nlp|computer vision|applied scientist|research engineer|mlops)\b", "Tech"),
    (r"\b(business intelligence|bi (developer|analyst|manager|engineer)|etl|data warehouse|database|dba|sql)\b", "Tech"),
    (r"\b(cyber|information security|infosec|security (engineer|analyst|architect|operations)|penetration test|appsec)\b", "Tech"),
    (r"\b(qa engineer|quality engineer|test engineer|sdet|automation engineer|controls engineer|robotics)\b", "Tech"),
    (r"\b(solutions? (engineer|architect|consultant)|forward deployed|sales engineer|support engineer|technical (support|consultant|account|program|project|delivery|writer)|implementation (engineer|consultant)|gtm engineer|partner engineer|field engineer|integration engineer)\b", "Tech"),
    (r"\b(identity management|iam|ict engineer|middleware|api |sdk|release engineer|build engineer|data governance|data platform|observability|technical lead|tech lead|systems? admin\w*|sysadmin|it (support|engineer|analyst|manager|specialist|technician|administrator)|help ?desk|desktop support|technical operations)\b", "Tech"),
    (r"\b(product manager|product owner|product management|technical product|product engineer|product design\w*|ux|ui|user experience|user research|interaction design)\b", "Tech"),
    (r"\b(engineering (manager|director|lead)|head of engineering|vp of engineering|cto|chief technology)\b", "Tech"),
    (r"\b(business systems analyst|systems analyst|solutions analyst|enterprise applications|salesforce|workday|sap|erp)\b", "Tech"),
    (r"\b(accountant|accounting|bookkeep\w*|controller|auditor|audit|tax|treasury|payroll|accounts payable|accounts receivable|fp a|financial|finance|actuar\w*|underwrit\w*|claims|insurance|investment|portfolio|equity|credit|billing|collections|revenue analyst)\b", "Finance & Accounting"),
    (r"\b(sales|seller|account (executive|manager|director)|business development|territory|revenue|quota|inside sales|sdr|bdr)\b", "Sales & Marketing"),
    (r"\b(marketing|brand|growth|seo|sem|content|copywriter|social media|communications|public relations|media relations|creative director|art director|demand gen\w*|campaign|producer)\b", "Sales & Marketing"),
    (r"\b(customer (success|support|service|experience)|client (success|services|onboarding|retention)|account coordinator|relationship manager|community manager|customer service representative)\b", "Sales & Marketing"),
    (r"\b(human resources|hr|hrbp|labor relations|employee relations|recruit\w*|talent|people (operations|business partner)|compensation|benefits|hris|onboarding specialist|training)\b", "HR & Operations"),
    (r"\b(administrative|office manager|executive assistant|receptionist|secretary|clerk|coordinator|scheduler)\b", "HR & Operations"),
    (r"\b(operations|logistics|supply chain|supply|procurement|sourcing|inventory|fulfilment|fulfillment|facilities|shipping|planner|buyer|vendor)\b", "HR & Operations"),
    (r"\b(leasing|property manager|real estate|facilities manager|store manager|branch manager|general manager|restaurant|retail|merchandis\w*)\b", "HR & Operations"),
)

#: Fixed values.  Titles that need a licence.
LICENSED = (
    r"\b(registered|licensed|practical|vocational|travel|staff|charge|school|duty|acuity|private duty)\s*nurse",
    r"\b(nurses?|registered nurses?|nurse practitioners?|licensed practical nurses?|licensed vocational nurses?|nurse anesthetists?|nurse midwi(fe|ves)|rn|lpn|lvn|cna|crna|np|bsn)\b",
    r"\b(physicians?|surgeons?|dentists?|endodontists?|orthodontists?|periodontists?|prosthodontists?|dental hygienists?|anesthesiologists?|radiologists?|psychiatrists?|optometrists?|podiatrists?|chiropractors?)\b",
    r"\b(pharmacists?|pharmacy technicians?)\b",
    r"\b(veterinarians?|licensed veterinary technicians?|lvt|veterinary technicians?)\b",
    r"\b(physical therapists?|occupational therapists?|respiratory therapists?|speech language pathologists?|speech therapists?|radiation therapists?|cota|pta|athletic trainers?|dietitians?|audiologists?)\b",
    r"\b(bcba|bcaba|board certified behavior analysts?|behavior analysts?)\b",
    r"\b(paramedics?|emt|emergency medical technicians?|sonographers?|ultrasound technologists?|radiologic technologists?|surgical technologists?)\b",
    r"\b(licensed clinical social workers?|lcsw|licensed professional counselors?|lpc|lmft|licensed therapists?|mental health counselors?)\b",
    r"\b(attorneys?|lawyers?|counsel|litigation associates?|solicitors?|barristers?)\b",
    r"\b(teachers?|substitute teachers?|special education teachers?|classroom teachers?|educators?)\b",
    r"\b(electricians?|journeymen|journeyman|master plumbers?|plumbers?|cdl|commercial drivers?|air traffic controllers?)\b",
    r"\bhvac\b.*\b(technicians?|installers?|mechanics?|repair|service tech)\b|\b(technicians?|installers?|mechanics?)\b.*\bhvac\b",
    r"\b(insurance producers?|insurance agents?|real estate agents?|realtors?|mortgage loan officers?|licensed appraisers?)\b",
)

#: Fixed values.  Countries and regions outside the US.
FOREIGN_COUNTRIES = (
    "emea", "apac", "latam", "anz", "international", "united kingdom", "uk", "england", "scotland", "wales", "ireland", "canada", "india",
    "singapore", "germany", "australia", "france", "netherlands", "spain", "italy", "portugal", "sweden", "norway", "denmark", "finland",
    "switzerland", "belgium", "austria", "poland", "romania", "ukraine", "czech", "hungary", "greece", "turkey", "israel", "japan", "china", "korea",
    "taiwan", "hong kong", "thailand", "vietnam", "malaysia", "indonesia", "philippines", "pakistan", "bangladesh", "sri lanka", "new zealand",
    "south africa", "nigeria", "kenya", "egypt", "brazil", "brasil", "mexico", "argentina", "chile", "colombia", "peru", "uruguay",
    "united arab emirates", "saudi arabia", "qatar", "morocco", "bulgaria", "serbia", "croatia", "slovakia", "slovenia", "lithuania", "latvia",
    "estonia", "iceland", "luxembourg", "malta", "europe", "asia", "africa", "oceania", "latin america", "middle east", "worldwide",
)

#: Fixed values.  Country and state level signs of the US.
US_TERMS = (
    "united states", "u.s.a", "usa", "u.s.", "us only", "remote - us", "remote, us", "remote (us", "remote us", "us remote", "anywhere in the us",
    "nationwide", "puerto rico", "parish", "alabama", "alaska", "arizona", "arkansas", "california", "colorado", "connecticut", "delaware", "florida",
    "georgia", "hawaii", "idaho", "illinois", "indiana", "iowa", "kansas", "kentucky", "louisiana", "maine", "maryland", "massachusetts", "michigan",
    "minnesota", "mississippi", "missouri", "montana", "nebraska", "nevada", "new hampshire", "new jersey", "new mexico", "new york",
    "north carolina", "north dakota", "ohio", "oklahoma", "oregon", "pennsylvania", "rhode island", "south carolina", "south dakota", "tennessee",
    "texas", "utah", "vermont", "virginia", "washington", "west virginia", "wisconsin", "wyoming", "district of columbia",
)

#: Fixed values.  Cities abroad whose names US cities share.
SHARED_CITY_NAMES = (
    "brisbane", "venice", "cambridge", "birmingham", "athens", "paris", "berlin", "moscow", "dublin", "naples", "rome", "vienna", "milan", "toledo",
    "manchester", "lima", "hamburg", "odessa", "york", "glasgow", "oxford", "windsor", "richmond", "florence", "madrid", "lebanon", "versailles",
    "st. petersburg", "london", "bristol", "dover", "plymouth", "belfast", "geneva", "warsaw",
)

#: Fixed values.  Name and two-letter code of each state, in the order of look-up.
STATES = (
    ("Alabama", "al"), ("Alaska", "ak"), ("Arizona", "az"), ("Arkansas", "ar"), ("California", "ca"), ("Colorado", "co"), ("Connecticut", "ct"),
    ("Delaware", "de"), ("Florida", "fl"), ("Georgia", "ga"), ("Hawaii", "hi"), ("Idaho", "id"), ("Illinois", "il"), ("Indiana", "in"),
    ("Iowa", "ia"), ("Kansas", "ks"), ("Kentucky", "ky"), ("Louisiana", "la"), ("Maine", "me"), ("Maryland", "md"), ("Massachusetts", "ma"),
    ("Michigan", "mi"), ("Minnesota", "mn"), ("Mississippi", "ms"), ("Missouri", "mo"), ("Montana", "mt"), ("Nebraska", "ne"), ("Nevada", "nv"),
    ("New Hampshire", "nh"), ("New Jersey", "nj"), ("New Mexico", "nm"), ("New York", "ny"), ("North Carolina", "nc"), ("North Dakota", "nd"),
    ("Ohio", "oh"), ("Oklahoma", "ok"), ("Oregon", "or"), ("Pennsylvania", "pa"), ("Rhode Island", "ri"), ("South Carolina", "sc"),
    ("South Dakota", "sd"), ("Tennessee", "tn"), ("Texas", "tx"), ("Utah", "ut"), ("Vermont", "vt"), ("Virginia", "va"), ("Washington", "wa"),
    ("West Virginia", "wv"), ("Wisconsin", "wi"), ("Wyoming", "wy"), ("District of Columbia", "dc"),
)

#: Fixed values.  (label, pattern) of the audit flags.
RED_FLAGS = (
    ("citizen", r"\bcitizen(ship)?\b"),
    ("clearance", r"\bclearance\b"),
    ("secret / ts-sci", r"\b(top\s+secret|secret\s+clearance|ts\/sci|ts-sci)\b"),
    ("visa sponsorship", r"\b(visa|h-?1b|opt|cpt|stem\s+opt|immigration|work\s+authoriz\w*|green\s+card|employment\s+authoriz\w*)\b[^.]{0,40}\bsponsor|\bsponsor(ship|ing|ed)?\b[^.]{0,40}\b(visa|h-?1b|opt|cpt|stem\s+opt|immigration|work\s+authoriz\w*|green\s+card|employment\s+authoriz\w*)\b"),
    ("green card", r"\bgreen\s+card\b"),
    ("permanent resident", r"\bpermanent\s+resident"),
    ("ITAR / export-ctrl", r"\b(itar|export[\s-]?control|ear\s+controlled|export\s+administration)"),
    ("u.s. person", r"\b(u\.?\s?s\.?|united\s+states)\s+persons?\b"),
    ("polygraph", r"\bpolygraph\b"),
    ("public trust", r"\bpublic\s+trust\b"),
    ("naturalized", r"\bnaturaliz"),
    ("federal (agency)", r"\bfederal\s+(contract|government|agenc|background|clearance|employ|facilit)"),
    ("defense agency", r"\b(dod|department\s+of\s+defense|department\s+of\s+energy|nasa|intelligence\s+community)\b"),
    ("CFR / USC cite", r"\b\d{1,2}\s+(cfr|u\.?s\.?c\.?)\b"),
)

#: Fixed values.  Phrases of equal-opportunity sentences.
EEO_PHRASES = (
    "without regard to", "regardless of", "equal opportunity", "equal employment", "does not discriminate", "do not discriminate", "discriminat",
    "protected veteran", "affirmative action", "genetic information", "gender identity", "sexual orientation", "e-verify", "everify", "form i-9",
    "i-9", "employment eligibility verification", "right to work poster", "social security administration", "department of homeland",
    "marital status", "alienage", "protected characteristic", "protected by federal", "protected class", "eeo", "diversity, equity",
)

#: Fixed values.  Words without content for overlap checks.
STOPWORDS = (
    "a", "an", "and", "the", "to", "of", "in", "for", "with", "on", "at", "by", "from", "into", "as", "is", "are", "was", "were", "be", "been",
    "being", "this", "that", "these", "those", "it", "he", "she", "they", "them", "his", "her", "our", "your", "my", "we", "you", "i", "using", "use",
    "used", "across", "within", "over", "under", "after", "before", "between", "during", "through", "per", "via", "or", "nor", "not", "no", "so",
    "than", "then", "also", "both", "each", "any", "all", "more", "most", "other", "some", "such", "only", "own", "same", "up", "out", "off", "down",
)

#: Fixed values.  Past forms that do not end in -ed.
IRREGULAR_PAST = (
    "led", "built", "ran", "drove", "oversaw", "wrote", "made", "chose", "began", "brought", "bought", "taught", "sought", "held", "kept", "left",
    "met", "sent", "spent", "won", "stood", "understood", "grew", "drew", "flew", "knew", "threw", "gave", "took", "saw", "went", "came", "found",
    "got", "spoke", "broke", "rose", "rebuilt", "upheld", "overcame", "undertook",
)

#: Fixed values.  Verbs whose past form is their present form.
PAST_IDENTICAL = (
    "set", "cut", "put", "read", "cost", "hit", "let", "bet", "spread", "split", "shut", "burst", "forecast", "broadcast",
)

#: Fixed values.  Upper-case tokens that are skills, not credentials.
SAFE_CODES = (
    "SQL", "ETL", "ELT", "API", "APIS", "REST", "JSON", "HTTP", "HTTPS", "AWS", "GCP", "SAAS", "PAAS", "IAAS", "CI", "CD", "CICD", "NOSQL", "OLAP",
    "OLTP", "CRUD", "SDLC", "AGILE", "SCRUM", "JIRA", "HDFS", "YARN", "SPARK", "KAFKA", "LINUX", "UNIX", "BASH", "JAVA", "HTML", "GRPC", "SOAP",
    "RBAC", "IAM", "SSO", "MFA", "TLS", "SSL", "VPC", "CDN", "DNS", "GPU", "CPU", "RAM", "ML", "AI", "LLM", "MLOPS", "DEVOPS", "DATAOPS", "ITIL",
)

#: Fixed values.  Query words that do not tell roles apart.
GENERIC_WORDS = (
    "senior", "sr", "junior", "jr", "staff", "lead", "principal", "entry", "mid", "level", "i", "ii", "iii", "iv", "associate", "head", "chief",
    "director", "manager", "intern", "internship", "of", "the", "and", "a", "an", "in", "for", "at",
)

#: Fixed value.  Section titles.
RESUME_SECTION = r"^(SUMMARY|PROFESSIONAL SUMMARY|OBJECTIVE|SKILLS|TECHNICAL SKILLS|TECHNICAL PROFICIENCY|CORE COMPETENCIES|EXPERIENCE|PROFESSIONAL EXPERIENCE|WORK EXPERIENCE|EMPLOYMENT|PROJECTS|KEY PROJECTS|NOTABLE PROJECTS|EDUCATION|CERTIFICATIONS|CERTIFICATIONS & LICENSES|LICENSES|PUBLICATIONS|AWARDS|VOLUNTEER EXPERIENCE|LANGUAGES|INTERESTS)\s*$"

#: Fixed values.  Signs that an employer sponsors.
SPONSOR_SIGNS = (
    r"\bwill\s+sponsor\b",
    r"\bvisa\s+sponsorship\s+(is\s+)?(available|offered|provided)\b",
    r"\b(offer|offers|offering|provide|provides|providing)\s+(visa\s+)?sponsorship\b",
    r"\bh-?1b\s+sponsor",
    r"\bsponsorship\s+(is\s+)?available\b",
    r"\bwe\s+sponsor\b",
    r"\bsponsorship\s+(is\s+)?provided\b",
    r"\bopen\s+to\s+sponsorship\b",
    r"\bimmigration\s+sponsorship\b",
)

#: Fixed values.  Places and phrases that stand for the US.
US_PLACES = (
    "united states", "u.s.a", "usa", "u.s.", "us only", "remote - us", "remote, us", "remote (us", "remote us", "us remote", "anywhere in the us",
    "nationwide", "puerto rico", "alabama", "alaska", "arizona", "arkansas", "california", "colorado", "connecticut", "delaware", "florida",
    "georgia", "hawaii", "idaho", "illinois", "indiana", "iowa", "kansas", "kentucky", "louisiana", "maine", "maryland", "massachusetts", "michigan",
    "minnesota", "mississippi", "missouri", "montana", "nebraska", "nevada", "new hampshire", "new jersey", "new mexico", "new york",
    "north carolina", "north dakota", "ohio", "oklahoma", "oregon", "pennsylvania", "rhode island", "south carolina", "south dakota", "tennessee",
    "texas", "utah", "vermont", "virginia", "washington", "west virginia", "wisconsin", "wyoming", "district of columbia", "washington dc",
    "washington d.c", "san francisco", "los angeles", "san diego", "san jose", "chicago", "seattle", "boston", "austin", "denver", "atlanta", "miami",
    "houston", "dallas", "phoenix", "philadelphia", "detroit", "minneapolis", "portland", "charlotte", "nashville", "pittsburgh", "baltimore",
    "st. louis", "salt lake city", "kansas city", "las vegas", "san antonio", "columbus", "indianapolis", "raleigh", "orlando", "tampa", "sacramento",
    "cincinnati", "cleveland", "milwaukee", "new orleans", "oklahoma city", "albuquerque", "tucson", "omaha", "boulder", "palo alto", "mountain view",
    "sunnyvale", "santa clara", "menlo park", "cupertino", "redmond", "bellevue", "brooklyn", "manhattan", "arlington va", "nyc", "new york city",
    "sf bay", "dc metro", "d.c.", "bronx", "queens ny", "staten island", "el segundo", "greensboro", "midland", "odessa", "san angelo",
    "fayetteville", "temple tx", "waco", "abilene", "amarillo", "lubbock", "wichita falls", "tyler tx", "beaumont", "killeen", "cornell university",
    "nyu", "new york university", "harvard", "stanford", "mit ", "yale", "princeton university", "columbia university", "duke university", "ucla",
    "usc ", "berkeley", "parish", "sierra vista", "flagstaff", "kingman", "yuma", "casa grande", "bullhead city", "prescott", "lake havasu", "sedona",
    "tempe", "glendale az", "peoria az", "surprise az", "goodyear", "maricopa", "san tan valley", "oro valley", "marana", "buckeye", "avondale",
    "apache junction", "bay area", "silicon valley", "socal", "norcal", "tri-state", "midwest", "new england", "east coast", "west coast",
    "pacific northwest", "south florida", "southern california", "northern california", "greater boston", "greater seattle", "dmv area", "bay-area",
    "fort lauderdale", "boca raton", "san luis obispo", "delray beach", "peabody", "roslyn", "new canaan", "darien", "greenwich", "ardmore",
    "cambridge", "modesto", "merced", "flushing", "jersey city", "newark", "hoboken", "stamford", "hartford", "providence", "albany", "buffalo",
    "rochester", "syracuse", "richmond", "norfolk", "virginia beach", "charleston", "savannah", "jacksonville", "st. petersburg", "fort myers",
    "naples fl", "sarasota", "gainesville", "birmingham", "montgomery", "huntsville", "memphis", "knoxville", "chattanooga", "louisville",
    "lexington", "columbia", "greenville", "asheville", "durham", "chapel hill", "wilmington", "des moines", "madison", "green bay", "ann arbor",
    "grand rapids", "lansing", "toledo", "akron", "dayton", "fort wayne", "south bend", "peoria", "springfield", "wichita", "tulsa", "little rock",
    "shreveport", "baton rouge", "mobile", "jackson ms", "boise", "spokane", "tacoma", "eugene", "reno", "fresno", "bakersfield", "stockton",
    "irvine", "pasadena", "santa monica", "long beach", "anaheim", "riverside", "oakland", "berkeley", "santa barbara", "ventura", "carlsbad",
    "scottsdale", "mesa", "chandler", "colorado springs", "fort collins", "provo", "ogden", "anchorage", "honolulu", "el paso", "laredo",
    "corpus christi", "arlington tx", "plano", "frisco", "irving", "fort worth", "round rock", "allen tx", "mclean", "reston", "herndon", "bethesda",
    "rockville", "annapolis", "wilmington de", "princeton", "trenton", "allentown", "harrisburg", "scranton", "white plains", "yonkers",
    "stamford ct", "norwalk",
)

#: Fixed values.  Places and phrases that stand for abroad, in the order of look-up.
FOREIGN_PLACES = (
    "emea", "apac", "latam", "anz", "international", "united kingdom", "england", "scotland", "wales", "canada", "india", "singapore", "ireland",
    "germany", "australia", "france", "netherlands", "spain", "italy", "portugal", "sweden", "norway", "denmark", "finland", "switzerland", "belgium",
    "austria", "poland", "romania", "ukraine", "czech", "hungary", "greece", "turkey", "israel", "japan", "china", "korea", "taiwan", "hong kong",
    "thailand", "vietnam", "malaysia", "indonesia", "philippines", "pakistan", "bangladesh", "sri lanka", "new zealand", "south africa", "nigeria",
    "kenya", "egypt", "brazil", "mexico", "argentina", "chile", "colombia", "peru", "uruguay", "united arab emirates", "saudi arabia", "qatar",
    "morocco", "london", "manchester", "edinburgh", "glasgow", "dublin", "belfast", "toronto", "vancouver", "montreal", "calgary", "ottawa",
    "bangalore", "bengaluru", "hyderabad", "chennai", "mumbai", "pune", "gurgaon", "gurugram", "noida", "kolkata", "ahmedabad", "new delhi", "berlin",
    "munich", "frankfurt", "hamburg", "cologne", "stuttgart", "sydney", "melbourne", "brisbane", "perth", "amsterdam", "rotterdam", "madrid",
    "barcelona", "lisbon", "porto", "stockholm", "copenhagen", "oslo", "helsinki", "zurich", "geneva", "brussels", "prague", "warsaw", "krakow",
    "budapest", "bucharest", "istanbul", "dubai", "abu dhabi", "riyadh", "doha", "cairo", "lagos", "nairobi", "tel aviv", "tokyo", "osaka",
    "shanghai", "beijing", "shenzhen", "seoul", "taipei", "bangkok", "jakarta", "manila", "kuala lumpur", "sao paulo", "buenos aires", "santiago",
    "bogota", "auckland", "wellington", "vienna", "europe", "asia", "africa", "oceania", "latin america", "paris", "milan", "rome", "naples", "turin",
    "florence", "venice", "sofia", "bulgaria", "serbia", "belgrade", "croatia", "zagreb", "slovakia", "slovenia", "lithuania", "latvia", "estonia",
    "monterrey", "guadalajara", "fortaleza", "curitiba", "brasilia", "recife", "porto alegre", "belo horizonte", "medellin", "lima", "quito",
    "caracas", "panama", "costa rica", "guatemala", "montevideo", "asuncion", "la paz", "santo domingo", "san salvador", "tegucigalpa", "remoto",
    "hibrido", "teletrabajo", "anywhere in europe", "anywhere in the world", "worldwide", "global remote", "remote global", "marseille", "lyon",
    "nice, france", "bordeaux", "toulouse", "valencia", "seville", "malaga", "bilbao", "antwerp", "ghent", "utrecht", "eindhoven", "the hague",
    "gothenburg", "malmo", "aarhus", "bergen", "tampere", "basel", "bern", "lausanne", "graz", "salzburg", "katowice", "wroclaw", "gdansk", "poznan",
    "brno", "ostrava", "cluj", "timisoara", "iasi", "thessaloniki", "ankara", "izmir", "jerusalem", "haifa", "beirut", "amman", "kuwait", "bahrain",
    "muscat", "karachi", "lahore", "islamabad", "dhaka", "colombo", "kathmandu", "hanoi", "ho chi minh", "da nang", "cebu", "davao", "surabaya",
    "bandung", "penang", "johor", "christchurch", "hamilton", "accra", "kampala", "dar es salaam", "addis ababa", "casablanca", "tunis", "algiers",
    "durban", "cape town", "johannesburg", "pretoria", "middle east", "remote international",
)

#: Fixed values.  Ordinary phrases that hold a flag word, by label.
BENIGN_PHRASES = {
    "citizen": ("citizen engagement", "citizen experience", "citizen services", "citizen-facing", "citizen data scientist", "citizens of the world", "good corporate citizen"),
    "clearance": (
        "regulatory clearance", "fda clearance", "510(k)", "customs clearance", "line clearance", "inventory clearance", "clearance sale", "creepage",
        "clearance to see clients", "background check", "clearance risk"),
    "defense agency": ("astronaut training", "space center", "nasa attractions", "near nasa"),
}
#: Labels whose flags equal-opportunity sentences raise as well.
EEO_PRONE = ("citizen", "federal (agency)")

#: Fixed values.  What a refusal to sponsor sounds like; words of other restrictions; words of a requirement; any mention.
NEGATIVE_SPONSOR = (
    r"\bnot\b.{0,40}\bsponsor", r"\bno\b.{0,30}\bsponsor", r"\bcannot\b.{0,30}\bsponsor", r"\bunable\b.{0,30}\bsponsor", r"\bwithout\b.{0,30}\bsponsor",
    r"\bineligible\b.{0,30}\bsponsor", r"\bnever\b.{0,30}\bsponsor", r"\bdo not\b.{0,30}\bsponsor", r"\bdoes not\b.{0,30}\bsponsor", r"\bwill not\b.{0,30}\bsponsor",
    r"\bunavailable\b.{0,30}\bsponsor", r"\bsponsor\w*\b.{0,40}\b(unavailable|not available|not offered|not provided|is not|are not)\b",
)
OTHER_HINTS = (r"\bcitizen", r"\bclearance", r"\bgreen card", r"\bsecurity\s+clearance", r"\bts\/sci")
REQUIREMENT = r"\b(required|must be|must have|only|requires)\b"
SPONSOR_MENTION = r"\b(sponsor(ship|ed|ing)?|work authoriz|work authoris|h-?1b|green card|permanent resident|u\.?s\.? citizen|security clearance|export[- ]control|itar|employment eligibility)\b"

#: Fixed values.  The older taxonomy of titles: a category and the texts of which a padded lower-case title holds one.
TITLE_KEYWORDS = (
    ("Software / Data / IT", (
        "software", "developer", "engineer, back", "backend", "back-end", "frontend", "front-end",
        "full stack", "fullstack", "data engineer", "data scientist", "data analyst", "machine learning",
        " ml ", "ai engineer", "devops", "sre", "site reliability", "cloud", "security engineer",
        "qa engineer", "test engineer", "mobile engineer", "ios engineer", "android engineer",
        "platform engineer", "infrastructure engineer", "systems engineer", "network engineer",
        "database", "analytics engineer", "business intelligence", "programmer", "architect",
        "technical program", "product manager", "ux ", "ui ", "designer", "computer",
    )),
    ("Other engineering / science", (
        "mechanical", "electrical", "civil", "chemical engineer", "aerospace", "manufacturing engineer",
        "process engineer", "quality engineer", "industrial engineer", "hardware", "firmware",
        "research scientist", "biologist", "chemist", "physicist", "laboratory", "r&d",
        "structural", "materials", "optical", "rf engineer", "validation engineer",
    )),
    ("Healthcare / clinical", (
        "nurse", " rn ", "rn -", "rn,", "lpn", "physician", "medical assistant", "clinical",
        "therapist", "hospice", "patient", "caregiver", "veterinar", "dental", "pharmac",
        "radiolog", "surgical tech", "phlebotom", "behavioral health", "social worker",
        "home health", "nursing", "health aide", "counselor",
    )),
    ("Sales / marketing / CS", (
        "sales", "account executive", "account manager", "business development", "marketing",
        "customer success", "customer support", "brand", "growth", "partnerships", "seo",
        "content", "social media", "communications", "public relations", "demand generation",
    )),
    ("Finance / accounting / legal", (
        "accountant", "accounting", "finance", "financial", "controller", "auditor", "audit",
        "tax ", "treasury", "payroll", "underwrit", "actuar", "legal", "attorney", "paralegal",
        "compliance", "investment", "portfolio",
    )),
    ("HR / admin / operations", (
        "human resources", " hr ", "recruit", "talent", "people operations", "administrative",
        "office manager", "executive assistant", "coordinator", "operations", "warehouse",
        "logistics", "supply chain", "facilities", "driver", "technician", "maintenance",
        "production", "assembler", "shift", "store manager", "retail", "cashier", "server",
        "cook", "janitor", "custodian", "security officer", "teacher", "instructor",
    )),
)

#: Fixed values.  The older industries of a text: a name and its whole words, in order of precedence.
INDUSTRY_KEYWORDS = (
    ("Financial Services", ("bank", "banking", "lending", "loans", "treasury", "liquidity", "payments", "fintech", "financial services", "fund administrator", "asset management", "investment", "capital markets")),
    ("Healthcare", ("patient", "clinical", "healthcare", "hospital", "medical", "therapy", "pharma", "pharmaceutical")),
    ("Consulting", ("consulting", "consultancy", "advisory services", "client engagements")),
    ("Defense & Government", ("defense", "military", "national security", "department of defense", "government contract")),
    ("Education", ("education", "university", "academy", "students", "curriculum", "learning platform")),
    ("Energy & Manufacturing", ("battery", "energy storage", "manufacturing", "supply chain", "recycling", "clean energy")),
    ("Insurance", ("insurance", "underwriting", "claims", "policyholder")),
    ("Retail & E-commerce", ("retail", "e-commerce", "ecommerce", "marketplace", "shopping", "merchandise")),
    ("Technology / SaaS", ("software", "saas", "cloud platform", "data engineering", "artificial intelligence", "machine learning", "mobile app", "text-to-speech")),
)

#: Fixed values.  Whole words that hint at a foreign place, in order.
FOREIGN_HINTS = (
    "canada", "united kingdom", "india", "germany", "france", "ireland", "australia", "singapore",
    "netherlands", "spain", "portugal", "sweden", "norway", "denmark", "finland", "switzerland",
    "belgium", "austria", "poland", "romania", "ukraine", "turkey", "israel", "united arab emirates",
    "saudi arabia", "egypt", "nigeria", "kenya", "south africa", "argentina", "chile", "colombia",
    "brazil", "mexico", "japan", "china", "south korea", "taiwan", "hong kong", "thailand", "vietnam",
    "malaysia", "indonesia", "philippines", "pakistan", "bangladesh", "sri lanka", "new zealand",
    "london", "manchester", "edinburgh", "glasgow", "dublin", "toronto", "vancouver", "montreal",
    "calgary", "ottawa", "edmonton", "winnipeg", "bengaluru", "bangalore", "hyderabad", "chennai",
    "mumbai", "pune", "gurgaon", "gurugram", "noida", "kolkata", "ahmedabad", "new delhi", "munich",
    "frankfurt", "hamburg", "cologne", "stuttgart", "dusseldorf", "sydney", "melbourne", "brisbane",
    "perth", "adelaide", "amsterdam", "rotterdam", "madrid", "barcelona", "lisbon", "porto", "stockholm",
    "gothenburg", "copenhagen", "oslo", "helsinki", "zurich", "geneva", "brussels", "prague", "warsaw",
    "krakow", "budapest", "bucharest", "istanbul", "dubai", "abu dhabi", "riyadh", "doha", "cairo",
    "lagos", "nairobi", "tel aviv", "tokyo", "osaka", "shanghai", "beijing", "shenzhen", "guangzhou",
    "hangzhou", "seoul", "taipei", "bangkok", "jakarta", "manila", "kuala lumpur", "sao paulo",
    "buenos aires", "santiago", "bogota", "montevideo", "auckland", "wellington",
)

#: Fixed values.  A remote place abroad.
REMOTE_ABROAD = r"\bremote\b[\s\-–—,()\/|]*\b(eu|uk|apac|emea|latam|anz|europe|asia|africa|india|brazil|canada|mexico|ireland|germany|france|spain|italy|poland|ukraine|australia|singapore|japan|china|philippines|latin\s+america|middle\s+east|united\s+kingdom)\b"

#: Fixed values.  The older contract filter: the title, part-time work and what excuses it, weaker signs and what excuses them, a position.
OLD_CONTRACT_TITLE = r"(?i)\([^)]*\bcontracts?\b[^)]*\)"
OLD_PART_TIME, OLD_FULL_TIME = r"\bpart[\s-]?time\b", r"\bfull[\s-]?time\b"
OLD_TEMPORARY, OLD_PERMANENT = r"\b(contractors?|temporary|temp position|fixed[\s-]?term)\b", r"\bpermanent\b"
OLD_CONTRACT_ROLE = r"\bcontract\s+(position|role|basis|engagement|assignment)\b"

#: Fixed values.  Contract work: part-time and temporary words, what excuses each near them, what states a contract outright, its roles, a title's brackets.
CONTRACT_TITLE = r"(?i)\([^)]*\bcontracts?\b[^)]*\)"
PART_TIME, PART_TIME_EXCUSES = r"\bpart[\s-]?time\b", r"\bfull[\s-]?time\b|\bopportunities\b"
TEMPORARY, TEMPORARY_EXCUSES = r"\b(?:contractors?|temporary|temp position|fixed[\s-]?term)\b", r"\bpermanent\b|\b(?:eligible|will not)\b"
CONTRACT_STATED = (
    r"\b(?:employment|job|position)\s+type\s*:\s*[^.\n]{0,25}\b(?:contract|b2b|freelance|fixed[\s-]?term|temporary|temp)\b",
    r"\bcontract\s+(?:length|duration|term)\s*:",
    r"\bcontract\s*\(\s*b2b\s*\)",
)
CONTRACT_ROLE = r"\bcontract\s+(?:position|role|basis|engagement|assignment)\b"

#: Fixed values.  Titles without a licence: those that end in such a role, and commercial words before a separator.
UNLICENSED_ROLE = r"\b(?:representative|rep|executive|recruiter|salesperson|seller)\s*$"
COMMERCIAL = r"\b(?:sales|account manager|account director|business development|territory|marketing|partnerships?|customer success)\b"

#: Fixed values.  (pattern, level) in order of precedence, on lower-case titles.
LEVELS = (
    (r"\b(?:director|vp|vice president|head of|principal)\b", "Director"), (r"\bstaff\b", "Staff"), (r"\b(?:senior|sr|lead)\b", "Senior"),
    (r"\b(?:intern|internship|co-?op)\b", "Internship"), (r"\b(?:entry|junior|jr|new grad|graduate|associate)\b", "Entry"),
    (r"\b(?:engineer|analyst|specialist|developer|coordinator|manager)\s+[i1]\b", "Entry"),
)

#: Fixed values.  Pay ranges (the third in thousands), the words near one that confirm it, and those that doubt it.
AMOUNT, PAY_DASH = r"([0-9]{2,3}(?:,[0-9]{3})+)", "[–—-]"
PAY_SHAPES = (
    rf"\$\s?{AMOUNT}\s?{PAY_DASH}\s?\$?\s?{AMOUNT}", rf"{AMOUNT}\s?{PAY_DASH}\s?{AMOUNT}\s?(?:USD|usd)\b",
    rf"\$\s?([0-9]{{2,3}})[kK]\s?{PAY_DASH}\s?\$?\s?([0-9]{{2,3}})[kK]\b", rf"\$\s?{AMOUNT}\s+to\s+\$?\s?{AMOUNT}",
)
PAY_WORDS = r"(?i)\b(?:salary|compensation|pay range|base pay|annual salary|base salary|total compensation|salary range|/\s?year|per year)\b"
MONEY_WORDS = r"(?i)\b(?:raised|funding|valuation|revenue|series [a-e]|investment|market size|arr|assets under management|aum)\b"

#: Fixed values.  (years asked for, whether it is a range), the words near one that confirm it, and those that doubt it.
YEAR_SHAPES = ((r"(?i)([0-9]{1,2})\s*-\s*([0-9]{1,2})\s*\+?\s*years?\b", True), (r"(?i)([0-9]{1,2})\+\s*years?\b", False), (r"(?i)(?:minimum|at least)\s*(?:of\s*)?([0-9]{1,2})\s*years?\b", False))
YEAR_WORDS = r"(?i)\b(?:experience|exp\b|background|similar role|in this field|working in|industry experience|relevant experience)\b"
AGE_WORDS = r"(?i)\b(?:founded|established|in business|company history|since [0-9]{4}|anniversary|celebrating|been around|has been|have been|for more than|for over)\b"

#: Fixed values.  Signs of a resume: an address, a telephone number, a section, a range of dates.
RESUME_SIGNS = (
    r"(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}", r"(\+?[0-9]{1,3}[\s.-]?)?\(?[0-9]{3}\)?[\s.-]?[0-9]{3}[\s.-]?[0-9]{4}",
    r"(?i)\b(?:experience|employment|work history|education|skills|projects|certifications|qualifications|professional summary|objective)\b",
    r"(?i)\b(?:19|20)[0-9]{2}\s*[–—to-]+\s*(?:(?:19|20)[0-9]{2}|present|current)\b|\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+(?:19|20)[0-9]{2}\b",
)

#: Fixed values.  Credentials that are no skills: their words, codes, exams, and words shaped like a code.
CREDENTIAL_WORDS = r"(?i)\b(?:certified|certification|certificate|credential|licen[sc]e|associate|practitioner|specialty)\b"
CREDENTIAL_CODE = r"\b[A-Z]{2,4}-?[0-9]{2,3}\b"
EXAMS = "PMP|CISSP|CISA|CISM|CCNA|CCNP|CCIE|CEH|CSM|CAPM|ITIL|PRINCE2|SAFE|OSCP|RHCE|RHCSA|MCSE|MCSA|VCP|VCAP|CKA|CKAD|CKS"
CODE_SHAPED = r"\b(?:[A-Z]{2,3}CE|[A-Z]{4,6}|(?:AWS|AZ|GCP|MS|CCNA|CCNP|PMP|CISSP|CISA|CSM|SAA|DP|AI|DVA)[- ]?[0-9]{2,3})\b"

#: Fixed values.  Words of a title that its stem leaves out.
STEM_WORDS = r"\b(senior|sr\.?|junior|jr\.?|staff|lead|principal|associate|assistant|head of|director of|vp|vice president|manager of|i{1,3}|iv|[0-9]+)\b"
