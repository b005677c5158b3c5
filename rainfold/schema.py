"""The tables of a basin."""

CELLS = "cell_id long, row int, col int, dem double, soil int, ndvi_min double, ndvi_max double, ldd int, station_id int, mask boolean"
FORCING = "cell_id long, step int, precipitation double, etp double, kp double, ndvi double, landuse int"
SERIES = "series string, step int, cell_id long, value double"
SOIL_ATTR = "soil int, bulk_density double, k_sat double, rootzone_depth double, t_sat double, t_wp double, t_fcap double"
LANDUSE_ATTR = "landuse int, manning double, a_v double, a_o double, a_s double, a_i double, kc_min double, kc_max double"
RAINY_DAYS = "month int, days double"
DRAIN = "cell_id long, down_id long"
OUTPUTS = ("itp", "bfw", "srn", "eta", "lfw", "rec", "smc", "rnf", "arn")
