import datetime as dt

COLUMNS = (
    "customer_id long, event_id long, session_id long, event_dttm timestamp_ntz, event_type_nm int, event_desc int, channel_indicator_type int, channel_indicator_sub_type int, "
    "operaton_amt double, currency_iso_cd int, mcc_code string, pos_cd int, timezone int, operating_system_type int, accept_language string, browser_language string, battery string, "
    "device_system_version string, screen_size string, developer_tools string, compromised string, web_rdp_connection int, phone_voip_call_state int, is_train int"
)
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]
DEFAULT = {
    "session_id": 1, "event_type_nm": 14, "event_desc": 5, "channel_indicator_type": 1, "channel_indicator_sub_type": 2, "operaton_amt": 10.0, "currency_iso_cd": 643, "mcc_code": "51", "pos_cd": 1,
    "timezone": 3, "operating_system_type": 1, "accept_language": "ru", "browser_language": "ru", "battery": "50 %", "device_system_version": "v1", "screen_size": "1080x1920", "developer_tools": "false",
    "compromised": "false", "web_rdp_connection": 0, "phone_voip_call_state": 0, "is_train": 1,
}
START = dt.datetime(2024, 1, 1, 12, 0, 0)


def tx(spark, rows):
    """Transactions from dicts: customer, id, minutes since START (or None), and what differs from DEFAULT."""
    made = []
    for r in rows:
        minutes = r.pop("minutes", 0)
        made.append(DEFAULT | {"event_dttm": None if minutes is None else START + dt.timedelta(minutes=minutes)} | r)
    return spark.createDataFrame([tuple(r[c] for c in NAMES) for r in made], COLUMNS)


def by_id(df):
    return {r.event_id: r for r in df.collect()}
