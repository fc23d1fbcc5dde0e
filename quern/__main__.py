"""Serves a store: python -m quern [--config FILE]."""

from __future__ import annotations

import argparse
import threading

from quern.engine import Config, Engine, default_root
from quern.sources import transport


def config(argv: list[str] | None = None, env: dict | None = None) -> Config:
    """The configuration of a file (TOML or JSON) and the environment; the root is a local folder if neither names one."""
    import os

    parser = argparse.ArgumentParser(prog="quern", description=__doc__)
    parser.add_argument("--config", help="a TOML or JSON file")
    values = Config._file(path) if (path := parser.parse_args(argv).config) else {}
    env = os.environ if env is None else env
    if "root" not in values and "QUERN_ROOT" not in env:
        values["root"] = default_root()
    return Config.load(values, env)


def main() -> None:
    from pyspark.sql import SparkSession

    settings = config()
    spark = SparkSession.builder.appName("quern").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    engine = Engine(spark, settings)
    server = transport.http_server(engine)
    try:
        flight = transport.flight_server(engine)
        threading.Thread(target=flight.serve, daemon=True).start()
    except ImportError:
        print("Arrow Flight is not installed: HTTP only", flush=True)
    print(f"serving {settings.root} on {settings.http_host}:{server.server_port}", flush=True)
    try:
        server.serve_forever()
    except KeyboardInterrupt:
        pass
    finally:
        server.server_close()
        spark.stop()


if __name__ == "__main__":
    main()
