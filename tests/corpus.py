"""A small corpus of four repositories in two languages, written for this engine's own checks."""

STORE = {
    "src/store/__init__.py": "from store.pricing import quote as public_quote\n",
    "src/store/basket.py": '''import os
from store.pricing import quote
from ledger.entries import post_entry
from store import public_quote


class Base:
    def audit(self):
        return 1


class Basket(Base):
    def checkout(self, items, *, fast=False):
        self.verify(items)
        amount = subtotal(items)
        quote(amount)
        post_entry(items)
        public_quote(amount)
        self.bus.announce_sale(items)
        return amount

    def verify(self, items):
        return bool(items)


def subtotal(items):
    factor = os.environ.get("VAT_FACTOR")
    return sum(items) * float(factor or 1)
''',
    "src/store/pricing.py": '''import os


def quote(amount):
    address = os.getenv("QUOTE_ADDRESS")
    return _ask(amount, address)


def _ask(amount, address):
    return amount
''',
    "src/store/main.py": '''from store.basket import Basket
from store.jobs import ship_parcel


def run_store():
    Basket().checkout([1, 2])
    ship_parcel.send(1)


if __name__ == "__main__":
    run_store()
''',
    "src/store/jobs.py": '''import dramatiq

PARCEL = "parcel-job"


@dramatiq.actor(actor_name=PARCEL)
def ship_parcel(n):
    return n
''',
    "appsettings.json": '{\n  "Quote": {\n    "Address": "https://example.invalid",\n    "Seconds": 30\n  },\n  "VAT_FACTOR": "0.2"\n}\n',
    ".env.example": "QUOTE_ADDRESS=\nVAT_FACTOR=0.2\n",
    "settings.config.yaml": "quote:\n  address: x\n  retry: [1, 2]\nlevel: 3\n",
    "pyproject.toml": '[project]\nname = "store"\n\n[project.scripts]\nstore = "store.main:run_store"\n',
}

LEDGER = {
    "src/ledger/__init__.py": "",
    "src/ledger/entries.py": '''def post_entry(items):
    return format_entry(items)


def format_entry(items):
    return str(items)
''',
    "src/ledger/news.py": "def announce_sale(items):\n    return items\n",
}

DISPATCH = {
    "Dispatch/IRoute.cs": "namespace Dispatch;\n\npublic interface IRoute\n{\n    Task<int> PlanAsync(Load load);\n}\n",
    "Dispatch/Route.cs": '''using Carriers;

namespace Dispatch;

public class Route : IRoute
{
    private readonly CarrierClient _carriers;

    public Route(CarrierClient carriers)
    {
        _carriers = carriers;
    }

    public async Task<int> PlanAsync(Load load)
    {
        Check(load);
        var cost = Tariff.Cost(load);
        await _carriers.BookAsync(cost);
        return cost;
    }

    private void Check(Load load)
    {
        load.RequireItems();
    }
}
''',
    "Dispatch/Load.cs": '''namespace Dispatch;

public record Load(int Id)
{
    public void RequireItems()
    {
    }
}

public static class Tariff
{
    public static int Cost(Load load) => load.Id * 2;
}
''',
    "Web/RouteController.cs": '''using Microsoft.Extensions.Configuration;
using Dispatch;

namespace Web
{
    public class RouteController
    {
        private readonly IRoute _route;
        private readonly IConfiguration _configuration;

        public RouteController(IRoute route, IConfiguration configuration)
        {
            _route = route;
            _configuration = configuration;
        }

        public async Task<int> Post(int id)
        {
            var address = _configuration["Quote:Address"];
            var load = new Load(id);
            _queue.Enqueue(Jobs.Parcel, id);
            return await _route.PlanAsync(load);
        }
    }

    public static class Jobs
    {
        public const string Parcel = "parcel-job";
    }
}
''',
    "Web/Program.cs": 'using Web;\n\nvar app = WebApp.Create(args);\nvar seconds = app.Configuration.GetValue<int>("Quote:Seconds");\napp.Run();\n',
}

CARRIERS = {
    "Carriers/CarrierClient.cs": '''namespace Carriers;

public class CarrierClient : ICarrierClient
{
    public async Task BookAsync(int cost)
    {
        var key = Environment.GetEnvironmentVariable("CARRIER_KEY");
        await PostAsync(cost);
    }

    private Task PostAsync(int cost)
    {
        return Task.CompletedTask;
    }
}

public interface ICarrierClient
{
    Task BookAsync(int cost);
}
''',
}

CORPUS = {"store": STORE, "ledger": LEDGER, "dispatch": DISPATCH, "carriers": CARRIERS}

#: (from, to, kind, rule) of every edge of the corpus.
EDGES = {
    ("store", "store.pricing.quote", "import", "import_scope"),
    ("store.basket", "store.pricing.quote", "import", "import_scope"),
    ("store.basket", "ledger.entries.post_entry", "import", "import_scope"),
    ("store.basket.Basket", "store.basket.Base", "inherit", "same_file"),
    ("store.basket.Basket.checkout", "store.basket.Basket.verify", "call", "same_file"),
    ("store.basket.Basket.checkout", "store.basket.subtotal", "call", "same_file"),
    ("store.basket.Basket.checkout", "store.pricing.quote", "call", "import_scope"),
    ("store.basket.Basket.checkout", "ledger.entries.post_entry", "call", "import_scope"),
    ("store.basket.Basket.checkout", "ledger.news.announce_sale", "call", "cross_repo_unique"),
    ("store.pricing.quote", "store.pricing._ask", "call", "same_file"),
    ("store.main", "store.basket.Basket", "import", "import_scope"),
    ("store.main", "store.jobs.ship_parcel", "import", "import_scope"),
    ("store.main.run_store", "store.basket.Basket", "instantiate", "import_scope"),
    ("store.main.run_store", "store.basket.Basket.checkout", "call", "repo_unique"),
    ("store.main.run_store", "store.jobs.ship_parcel", "call", "queue_match"),
    ("store.main", "store.main.run_store", "call", "same_file"),
    ("ledger.entries.post_entry", "ledger.entries.format_entry", "call", "same_file"),
    ("Dispatch.Route", "Dispatch.IRoute", "inherit", "same_namespace"),
    ("Dispatch.Route.PlanAsync", "Dispatch.Route.Check", "call", "same_file"),
    ("Dispatch.Route.PlanAsync", "Dispatch.Tariff.Cost", "call", "same_namespace"),
    ("Dispatch.Route.PlanAsync", "Carriers.CarrierClient.BookAsync", "call", "declared_type"),
    ("Dispatch.Route.Check", "Dispatch.Load.RequireItems", "call", "declared_type"),
    ("Web.RouteController.Post", "Dispatch.Load", "instantiate", "import_scope"),
    ("Web.RouteController.Post", "Dispatch.IRoute.PlanAsync", "call", "declared_type"),
    ("Web.RouteController.Post", "store.jobs.ship_parcel", "call", "queue_match"),
    ("Carriers.CarrierClient", "Carriers.ICarrierClient", "inherit", "same_file"),
    ("Carriers.CarrierClient.BookAsync", "Carriers.CarrierClient.PostAsync", "call", "same_file"),
}
