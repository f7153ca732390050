"""Codes with a meaning in the source system, and column lists of the report pages."""

CUTTING = 29  # work centre: cutting
SEWING = 47  # work centre: sewing
FORM_SALES_ORDER = 10
FORM_GARMENT_ORDER = 127
FORM_STOCK_NOTE = 131
SALE_TYPE = 4
ITEM_FORM = 10
APPROVED_SHARE = "0.9"  # part of the programmed kilos that an approved closing counts
REQUIRED_MARGIN = "1.075"  # kilos to assemble per required kilo

# Main table and sub-lists of the order pages.
ORDER_COLUMNS = {
    "delivery": [
        "PEDIDO", "F_EMISION", "F_ENTREGA", "DIAS", "CLIENTE", "PO", "KG_REQ", "KG_ARM", "KG_TEÑIDOS",
        "KG_DESPACH", "UNID", "PROG", "CORTADO", "COSIDO",
    ],
    "planned": [
        "PEDIDO", "F_EMISION", "F_ENTREGA", "DIAS", "CLIENTE", "PO", "KG_REQ", "KG_ARM", "KG_TEÑIDOS",
        "KG_APROB_D", "KG_DESPACH", "UNID", "PROG", "CORTADO", "COSIDO",
    ],
    "status": [
        "PEDIDO", "F_EMISION", "F_ENTREGA", "DIAS", "CLIENTE", "PO", "KG_REQ", "KG_ARMP", "KG_TEÑIDOSP",
        "KG_APROB_DP", "KG_DESPACHP", "UNID", "PROGP", "CORTADO", "CORTADOP", "COSIDO", "COSIDOP", "con_tela",
    ],
}
LIST_COLUMNS = {
    "kilos": {
        "to_assemble": ["PEDIDO", "F_ENTREGA", "CLIENTE", "UNID", "KG_REQ", "KG_X_ARM", "R1"],
        "to_dye": ["PEDIDO", "F_ENTREGA", "CLIENTE", "UNID", "KG_REQ", "KG_TEÑIDOS", "KG_ARM_X_TEÑIR"],
        "to_dispatch": [
            "PEDIDO", "F_ENTREGA", "CLIENTE", "UNID", "KG_REQ", "KG_DESPACH", "KG_APROB_D", "KG_X_DESPACH",
        ],
    },
    "status": {
        "to_assemble": ["PEDIDO", "F_ENTREGA", "CLIENTE", "UNID", "KG_REQ", "KG_X_ARMP", "KG_ARMP"],
        "to_dye": ["PEDIDO", "F_ENTREGA", "CLIENTE", "UNID", "KG_REQ", "KG_ARM_X_TEÑIRP"],
        "to_dispatch": [
            "PEDIDO", "F_ENTREGA", "CLIENTE", "UNID", "KG_REQ", "KG_DESPACHP", "KG_APROB_DP", "KG_X_DESPACHP",
        ],
    },
}
