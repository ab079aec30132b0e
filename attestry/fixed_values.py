"""Word lists, unit spellings, formats and label orders that
results depend on.  Plain text, kept together; no logic lives here."""

CATALOG_COLUMNS = ("Mfg_Part_Num", "Part_Desc", "E1_Brand", "Unilog_Brand", "DIB_Brand", "Part_Manuf")

TAXONOMY_COLUMNS = ("Segment", "Segment Name", "Family", "Family Name",
                    "Class", "Class Name", "Commodity", "Commodity Name")

DELIVERY_REQUIRED = ("Mfg_Part_Num", "Part_Desc", "MANUFACTURER_PART_NUMBER", "MANUFACTURER_NAME",
                     "BRAND_NAME", "Classpath", "UNSPSC", "MOBILE_DESC", "INVOICE_DESC",
                     "SHORT_DESC", "LONG_DESC1", "RETAIL_DESC")

# fixed column names of the delivery table, in order: before the features, between features and attribute slots, after the slots
DELIVERY_FIRST = ("MFR URL", "Ref URL 1", "Ref URL 2", "Ref URL 3", "Ref URL 4", "Ref URL 5", "PART_NUMBER", "Dept", "Class", "Fine",
                  "SKU - MY_PART_NUMBER", "Mfg_Part_Num", "Part_Desc", "E1_Brand", "Unilog_Brand", "DIB_Brand", "Part_Manuf",
                  "MANUFACTURER_NAME", "BRAND_NAME", "TRADE_NAME", "MANUFACTURER_PART_NUMBER", "ALTERNATE_PART_NUMBER", "Classpath",
                  "MOBILE_DESC", "INVOICE_DESC", "SHORT_DESC", "LONG_DESC1", "RETAIL_DESC", "MARKETING_DESCRIPTION")
DELIVERY_BEFORE_SLOTS = ("With", "Standard/Approvals", "Prop 65", "Application", "Includes", "Product Name")
DELIVERY_LAST = ("UPC", "EAN", "GTIN", "UNSPSC", "Warranty", "List Price", "Selling Qty", "Selling UOM", "Standard Packaging Information",
                 "LENGTH", "LENGTH_UOM", "HEIGHT", "HEIGHT_UOM", "WIDTH", "WIDTH_UOM", "WEIGHT", "WEIGHT_UOM", "VOLUME", "VOLUME_UOM",
                 "Product Image", "Alternate Image 1", "Alternate Image 2", "Alternate Image 3", "Alternate Image 4", "SDS", "SDS_1",
                 "Warranty Information", "Catalog", "Specification Sheet", "Instruction/Installation Manual", "Service Manual",
                 "Owners/User Manual", "Line Drawing", "MTR", "RoHS", "Full Engineering Drawing", "Energy Star Guide", "Technical Bulletin",
                 "Submittal", "Compatibility Chart", "Size Chart", "Product Label/Insert", "Video Link", "Video Link 1", "Country Of Origin",
                 "Discontinued", "Actual Image (Yes/No)")

DASHES = "‐‑‒–—−"

PLACEHOLDERS = ("", "-", "--", "n/a", "na", "none", "null", "not available", "unknown", "unbranded",
                "no brand", "no manufacturer", "no manuf", "no unilog brand", "no dib brand",
                "commodity - unbranded")
PLACEHOLDER_TRIM = " -_.,:;"

LEGAL_SUFFIXES = ("co", "company", "corp", "corporation", "inc", "incorporated",
                  "llc", "ltd", "limited", "plc")

MASTER_ALIASES = {
    "manufacturer_id": ("manufacturer_id", "mfr_id", "manufacturer_code"),
    "manufacturer_name": ("manufacturer_name", "mfr_name", "manufacturer"),
    "brand_id": ("brand_id", "brand_code"),
    "brand_name": ("brand_name", "brand"),
}
LOV_ALIASES = {
    "classpath": ("classpath", "category_path", "category"),
    "label": ("attribute", "attribute_name", "label"),
    "value": ("value", "lov_value", "canonical_value"),
    "uom": ("uom", "unit", "unit_of_measure"),
}

UNITS = {
    "V": ("v", "volt", "volts"),
    "A": ("a", "amp", "amps", "ampere", "amperes"),
    "in": ("in", "inch", "inches", '"'),
    "ft": ("ft", "foot", "feet", "'"),
    "lb": ("lb", "lbs", "pound", "pounds"),
    "W": ("w", "watt", "watts"),
    "Hz": ("hz", "hertz"),
    "dBA": ("dba",),
    "GPM": ("gpm", "gal/min", "gallons per minute"),
    "PSI": ("psi", "lb/in2", "lb/in²"),
    "°F": ("°f", "deg f", "degree f", "degrees f", "fahrenheit"),
    "°C": ("°c", "deg c", "degree c", "degrees c", "celsius"),
    "rpm": ("rpm", "rev/min"),
    "%": ("%", "percent"),
    "hr": ("hr", "hrs", "hour", "hours"),
    "kW-hr": ("kw-hr", "kwh", "kilowatt-hour", "kilowatt-hours"),
}
# spellings split off the end of a value (narrower than UNITS on purpose)
TRAILING_UNITS = ("gallons per minute|kilowatt-hours?|degrees? [fc]|fahrenheit|celsius|amperes?|"
                  "volts?|watts?|hertz|pounds?|inches|inch|feet|foot|gal/min|lb/in[2²]|deg [fc]|"
                  "kw-hr|kwh|rev/min|dba|gpm|psi|rpm|percent|hrs?|hours?|[vaiw]|in|ft|lb|hz|°[fc]|%|[\"']")
DIMENSION_WORDS = ("size", "length", "width", "height", "depth", "diameter", "thickness")

GENERIC_LABELS = ("Series", "Model", "Material", "Color", "Dimensions", "Weight",
                  "Voltage Rating", "Power Rating", "Certification/Compliance")

# classification query clean-up: (pattern, replacement), applied in this order
QUERY_REWRITES = (
    (r"\bdisplay\s+only\b", " "),
    (r"\bcut\s*(?:n|and)\s*grind\s+disc\b", "abrasive cutting grinding disc"),
    (r"\bpatio\s+dr\b", "patio door"),
)
# (patterns that must all match, words appended)
QUERY_EXPANSIONS = (
    ((r"\bpatio\s+door\b", r"\blow-?e\b"), "glass door"),
    ((r"\bSJ(?:E|EO|T|TO|TW|EOW|EW)A?\b",), "portable electrical cord"),
    ((r"\b\d{2}(?:\s*in\b|\").*\bfan\b",), "ceiling fan"),
)
# sibling rule: trigger, veto, rival, preferred and excluded patterns
SIBLING_TRIGGER = r"\bdish\s*wash(?:er|ers|ing machine|ing machines)\b"
SIBLING_VETO = (r"\b(?:commercial|industrial|restaurant|food\s*service|foodservice|institutional|"
                r"restaurant[- ]grade|nsf(?:\s+certified)?)\b")
SIBLING_NAME = r"\bdish\s*wash"
SIBLING_RIVAL = "commercial"
SIBLING_PREFERRED = "domestic"
SIBLING_EXCLUDED = "part"

BLOCKED_HOSTS = ("amazon.com", "facebook.com", "instagram.com", "linkedin.com",
                 "wikipedia.org", "youtube.com")
GENERIC_NAME_WORDS = ("company", "corporation", "manufacturing")
RESULT_LINK = r'class="result__a"[^>]*href="([^"]+)"[^>]*>(.*?)</a>'
RESULT_TEXT = r'class="result__(?:title|snippet)[^"]*"[^>]*>(.*?)</(?:a|div)>'
REDIRECT_PARAM = "uddg"

ENTAILMENTS = ("supported", "partially_supported", "not_supported", "ambiguous")
SOURCE_TYPES = ("description", "manufacturer_site")

DESCRIPTION_FIELDS = ("MOBILE_DESC", "INVOICE_DESC", "SHORT_DESC", "LONG_DESC1", "RETAIL_DESC",
                      "MARKETING_DESCRIPTION")
INVOICE_ORDER = ("Mounting Type", "Number of Wash Cycles", "Material", "Color",
                 "Voltage Rating", "Amperage Rating")
SHORT_ORDER = ("Mounting Type", "Number of Wash Cycles", "Material", "Color")
LONG_ORDER = ("Number of Wash Cycles", "Voltage Rating", "Amperage Rating", "Mounting Type",
              "Plug Type", "Size", "Depth With Door Open", "Minimum Height", "Maximum Height",
              "Sound Level", "Material", "Color", "Additional Information")
VALUE_ABBREVIATIONS = {"built-in": "BLTLN", "stainless steel": "SST"}

SAMPLE_STOPWORDS = ("the", "and", "for", "with", "from", "each", "only")
