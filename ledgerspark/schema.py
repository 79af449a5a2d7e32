"""Closed sets of the ledger's domain and its dimension tables. All are fixed values, stated as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# States, kinds and regimes.
LIVE_EXCLUDES = ("duplicado", "rechazado")
KINDS = ("ingreso", "gasto", "mejora", "amortizacion")
CI, AE = "capital_inmobiliario", "actividad_economica"

# Chart of accounts (code, name, kind, regime, tax box).
ACCOUNTS = [
    ("CI.ING.RENTA", "Alquiler", "ingreso", CI, "ingresos"),
    ("CI.ING.INDEMN", "Indemnización", "ingreso", CI, "ingresos"),
    ("CI.GAS.LUZ", "Luz", "gasto", CI, "suministros"),
    ("CI.GAS.AGUA", "Agua", "gasto", CI, "suministros"),
    ("CI.GAS.INTERNET", "Internet", "gasto", CI, "suministros"),
    ("CI.GAS.COMUNIDAD", "Comunidad", "gasto", CI, "comunidad"),
    ("CI.GAS.SEGURO", "Seguro", "gasto", CI, "seguros"),
    ("CI.GAS.IBI", "IBI", "gasto", CI, "ibi"),
    ("CI.GAS.HOGAR", "Hogar", "gasto", CI, "otros"),
    ("CI.GAS.REPARACION", "Reparación", "gasto", CI, "reparacion"),
    ("CI.GAS.INTERES", "Intereses", "gasto", CI, "intereses"),
    ("CI.GAS.ADMIN", "Administración", "gasto", CI, "admin"),
    ("CI.MEJ.PVC", "Ventanas", "mejora", CI, "mejoras"),
    ("CI.MEJ.SOLADO", "Suelo", "mejora", CI, "mejoras"),
    ("CI.MEJ.REVEST", "Revestimientos", "mejora", CI, "mejoras"),
    ("CI.MEJ.MO", "Mano de obra", "mejora", CI, "mejoras"),
    ("CI.MEJ.OTROS", "Otras mejoras", "mejora", CI, "mejoras"),
    ("CI.AMO.INMUEBLE", "Amortización", "amortizacion", CI, "amortizacion"),
    ("AE.ING.VENTAS", "Ingresos de explotación", "ingreso", AE, ""),
    ("AE.GAS.COMPRAS", "Compras y servicios", "gasto", AE, ""),
    ("AE.GAS.SUMINISTROS", "Suministros de la actividad", "gasto", AE, ""),
    ("AE.GAS.SS", "Seguridad social del autónomo", "gasto", AE, ""),
    ("AE.INV.BIENES", "Bienes de inversión", "mejora", AE, ""),
]

# Tax boxes in report order (key, label, group, whether it lowers the year's yield).
BOXES = [
    ("ingresos", "Ingresos", "ingreso", False),
    ("intereses", "Intereses", "gasto", True),
    ("reparacion", "Reparación", "gasto", True),
    ("ibi", "IBI", "gasto", True),
    ("comunidad", "Comunidad", "gasto", True),
    ("seguros", "Seguros", "gasto", True),
    ("suministros", "Suministros", "gasto", True),
    ("admin", "Administración", "gasto", True),
    ("otros", "Otros gastos", "gasto", True),
    ("amortizacion", "Amortización", "amortizacion", True),
    ("mejoras", "Mejoras", "mejora", False),
    ("sin_clasificar", "Sin clasificar", "gasto", True),
]

# VAT rates, tolerances in cents, folder names of accounts.
VAT_RATES = (21, 10, 4, 0)
HEADER_TOLERANCE, LINE_TOLERANCE = 2, 5
FOLDERS = {
    "CI.MEJ.MO": "mano-de-obra",
    "CI.MEJ.OTROS": "otras-mejoras",
    "CI.AMO.INMUEBLE": "amortizacion",
    "CI.GAS.REPARACION": "reparacion",
    "CI.GAS.INTERES": "interes",
    "CI.GAS.ADMIN": "administracion",
    "AE.GAS.SS": "seguridad-social",
    "AE.INV.BIENES": "bienes-inversion",
}

# Words that decide an account, in order of precedence (words, account, confidence).
KEYWORDS = [
    (("iberdrola", "endesa", "naturgy", "holaluz", "curenerg", "i-de redes"), "CI.GAS.LUZ", 0.9),
    (("aquavall", "aquona", "aqualia", "aguas de", "canal de isabel"), "CI.GAS.AGUA", 0.9),
    (("movistar", "telefonica", "telefónica", "orange", "vodafone", "digi ", "masmovil", "másmóvil", "yoigo", "pepephone", "lowi"), "CI.GAS.INTERNET", 0.88),
    (("comunidad de propietarios", "comunidad propietarios", "administrador de fincas"), "CI.GAS.COMUNIDAD", 0.92),
    (("mapfre", "allianz", "mutua madrileña", "línea directa", "linea directa", "zurich", "reale", "pelayo"), "CI.GAS.SEGURO", 0.85),
    ((" impuesto sobre bienes", " recibo ibi", "ibi ", "tasa de basura", "gerencia territorial"), "CI.GAS.IBI", 0.86),
    (("indemnizacion", "indemnización"), "CI.ING.INDEMN", 0.8),
    (("arrendamiento", "renta de alquiler", "recibo de alquiler"), "CI.ING.RENTA", 0.8),
    (("ventana", "ventanas", "climalit", "carpinteria", "carpintería"), "CI.MEJ.PVC", 0.72),
    (("tarima", "parquet", "solado", "suelo laminado", "porcelanico", "porcelánico"), "CI.MEJ.SOLADO", 0.72),
    (("revestimiento", "alicatado"), "CI.MEJ.REVEST", 0.7),
    (("leroy merlin", "bricomart", "bauhaus", "obramat", "bricoman"), "CI.GAS.HOGAR", 0.6),
]
DIY = ("leroy merlin", "bricomart", "bauhaus", "obramat", "bricoman")
WORKS = ("ventana", "ventanas", "climalit", "carpinteria", "carpintería", "tarima", "parquet", "solado", "suelo laminado", "revestimiento", "alicatado")
IMPROVEMENT = ("mejora", "reforma", "instalaci", "obra")
REPAIR = ("reparaci", "avería", "averia", "desatasco", "fontaner", "caldera")
LABOUR = ("mano de obra", "albañil", "albanil")
LABOUR_WORKS = ("pvc", "ventana", "tarima", "solado", "revest")
SOCIAL_SECURITY = ("seguridad social", "reta")

# Agreement weights. Each level is (probability if the same, probability if not); null gives no weight.
SUPPLIER_PRIOR, PAIR_PRIOR = 1 / 256, 1 / 2048
SUPPLIER_LEVELS = {"nif": [(0.99, 4e-6), (4e-6, 0.99)], "nombre": [(0.90, 1e-3), (0.06, 2e-3), (0.02, 8e-3), (0.006, 0.989)]}
PAIR_LEVELS = {
    "nif": [(0.99, 4e-6), (4e-6, 0.99)],
    "numero": [(0.97, 1e-5), (0.01, 0.90)],
    "fecha": [(0.75, 0.01), (0.10, 0.06), (0.02, 0.95)],
    "importe": [(0.95, 0.02), (0.002, 0.98)],
    "nombre": [(0.90, 0.05), (0.50, 0.10), (0.02, 0.95)],
}
MENTION, REVIEW = 0.90, 0.50


def accounts(spark: SparkSession) -> DataFrame:
    """System accounts; at most a few hundred rows with a user's own, so joins may broadcast it."""
    return spark.createDataFrame(ACCOUNTS, "codigo string, nombre string, tipo string, regimen string, casilla string")


def boxes(spark: SparkSession) -> DataFrame:
    """The twelve tax boxes with their place in the report."""
    return spark.createDataFrame([(i, *b) for i, b in enumerate(BOXES)], "orden int, casilla string, etiqueta string, grupo string, resta boolean")
