"""Column names of the work-order model, in one place."""

FECHA = "FECHA"
EJECUTIVO = "EJECUTIVO"
PEDIDO = "NUMERO_DE_PEDIDO"
STATUS = "STATUS_REAL"
TORRE = "TORRE"
REQUIRED = (FECHA, EJECUTIVO, PEDIDO, STATUS, TORRE)

MES = "Mes"
YEAR = "Year"
SEMANA = "Semana_Num"
WEEK_START = "WeekStartDate"
WEEK_END = "WeekEndDate"
WEEK_LABEL = "WeekLabel"
# Dropped from exports and previews; the month name stays.
HELPERS = (YEAR, SEMANA, WEEK_START, WEEK_END, WEEK_LABEL)

DIA = "Fecha_Dia"
N = "n"
FILAS = "filas"
MES_NUM = "mes_num"
# Layout of stored rows. A normalised header has no blank, so these can be no user's column.
LAYOUT_ANIO = "anio de fecha"
LAYOUT_MES = "mes de fecha"

# The two outcomes the indicators single out, and the label of totals.
CORREGIDO = "Corregido"
CAPACIDAD = "Capacidad"
TOTAL_GENERAL = "Total General"
