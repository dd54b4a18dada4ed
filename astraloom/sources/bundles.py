"""A small service per supplier, written by hand, whose names carry the supplier's key.

What a query must find in one service is written down once (`plans.bundles`) with @K@ for the key; all services are
alike and independent of each other, but for what their names say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from astraloom.sources.corpus import keys_of

KEY = "@K@"

PYTHON: dict[str, str] = {
    "__init__.py": '"""Service @K@."""\nfrom .models import Order_@K@\n',
    "main.py": '''"""Entry of @K@."""
from fastapi import FastAPI
from . import api
from .api import router as orders
import svc@K@.db.deep.more
import svc@K@.half
app = FastAPI()
app.include_router(orders, prefix="/s@K@")
app.include_router(orders)
app.include_router(orders, prefix=PREFIX)
@app.get("/ping")
def ping_@K@():
    return api.both_@K@()
''',
    "api.py": '''from .models import Order_@K@, LIMIT_@K@
from ..svc@K@ import db as store
@router.post("/orders")
@audit
async def create_@K@(body):
    try:
        import json
    except ImportError:
        json = None
    return save_@K@(body)
@router.route("/both", methods=["GET", "POST"])
def both_@K@():
    return LIMIT_@K@
''',
    "models.py": '''"""Models of @K@."""
class Order_@K@(Base):
    __tablename__ = "orders_@K@"
    deleted_at = Column()
    items = relationship("Item_@K@")
class Line_@K@(mixins.Part):
    """A line."""
LIMIT_@K@ = 50
default_@K@ = 3
def stub_@K@():
    """Nothing."""
    pass
''',
    "items.py": '''class Item_@K@(Model):
    __tablename__ = "items_@K@"
    def total_@K@(self):
        return [x for x in self.lines if x and self.ok or x > 3]
''',
    "db.py": '''def save_@K@(x):
    if x:
        return x
    while x:
        x = x - 1
    return None
def find_@K@(s):
    return s.query("orders_@K@").filter(1).all()
class Repo_@K@:
    def risky_@K@(self):
        raise ValueError("x")
def get_db():
    return 1
def get_session():
    return 2
''',
    "envy.py": "def many_@K@(x):\n" + "    save_@K@(x)\n" * 6,
    "typed.py": "from __future__ import annotations\nWIDTH_@K@: int = 1\n",
    "half.py": '''from svc@K@.idle import *
def wait_@K@(a):
    return [a, a, a, a]
''',
    "idle.py": '''IDLE_@K@ = "@K@"
def rest_@K@(a):
    return len(a) + len(a) + 1
''',
    "config.py": "MODE_@K@ = 1\n",
    "tools/run.py": '''import asyncio
def dispatch_@K@(db):
    asyncio.create_task(work())
    db.commit()
    db.close()
''',
    "jobs/helper.py": '''from svc@K@.db import save_@K@
from svc@K@.models import LIMIT_@K@
def expire_@K@():
    expires = datetime.now()
    return expires
def retry_@K@(x):
    try:
        risky_@K@()
    except ValueError as e:
        return save_@K@(e)
    return default_@K@
''',
    "text/helper.py": '''def cap_@K@(t):
    return t[:147]
''',
    "text/alt.py": '''def store_@K@(alt_text):
    save(alt_text)
''',
    "link_checker.py": '''MAX_RETRIES = 3
def check_@K@(a):
    return save_@K@(a)
''',
}

JAVASCRIPT: dict[str, str] = {
    "web/app.js": '''import React, { useState } from "react";
import * as api from './api@K@';
import "side@K@.css";
const fs = require("fs");
export default class App@K@ extends React.Component {
  constructor(props) { super(props); }
  static async load@K@(id) {
    const m = await import("./lazy@K@");
    if (id) { return m; }
  }
}
export function top@K@(a) {
  function inner@K@() { return a; }
  return inner@K@;
}
const arrow@K@ = async (x) => x;
let made@K@ = function () { return 1; }, plain@K@ = (1 + 2);
// import "comment";
const text = 'import "string"';
for (let i = 0; i < 3; i++) { top@K@(i); }
''',
    "web/view.jsx": '''import { Row@K@ } from "./row@K@";
const quote@K@ = /["'`]/;
export function List@K@({ xs }) {
  const label = `it's ${xs.map((x) => `"${x}"`).join("'")}`;
  return <ul title="it's">Don't {xs.map((x) => <Row@K@ key={x} on={() => { const deep@K@ = () => x; return deep@K@(); }}>isn't</Row@K@>)}</ul>;
}
function after@K@(a) { return a / 2 / 3; }
''',
    "web/side.js": '''class Bare@K@ { run() {} }
function top@K@() {}
function top@K@() {}
''',
}


def files(spark: SparkSession, sf_dir: str, which: dict[str, str]) -> DataFrame:
    """path, content: every file of `which` below svcK/ for every supplier K."""
    texts = spark.createDataFrame(sorted(which.items()), "name string, text string")
    keyed = keys_of(spark, sf_dir, "supplier", "s_suppkey").select(F.col("s_suppkey").cast("string").alias("k"))
    path = F.concat(F.lit("svc"), "k", F.lit("/"), "name")
    return keyed.join(F.broadcast(texts), F.lit(True)).select(path.alias("path"), F.replace("text", F.lit(KEY), F.col("k")).alias("content"))  # a score of texts
