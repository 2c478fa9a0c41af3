"""A small corpus in ten languages, and what its calls and imports must bind to (written by hand)."""

SOURCES = {
    "app/main.py": ("python", 'from app.store import Store\nimport app.util\n\ndef run(x):\n    """Run it."""\n    s = Store()\n    s.save(x)\n    return helper(x)\n\ndef helper(y):\n    return app.util.norm(y)\n'),
    "app/store.py": ("python", "class Store:\n    def save(self, x):\n        self._put(x)\n    def _put(self, x):\n        pass\n"),
    "app/util.py": ("python", "def norm(v):\n    return v\n\ndef test_norm():\n    norm(1)\n"),
    "src/lib.rs": ("rust", "use crate::shape::Circle;\n/// Area of things.\npub trait Area { fn area(&self) -> f64; }\nimpl Area for Circle {\n    fn area(&self) -> f64 { self.helper() }\n}\nimpl Circle { fn helper(&self) -> f64 { compute(3) } }\nfn compute(x: i32) -> f64 { 0.0 }\n"),
    "src/shape.rs": ("rust", "pub struct Circle { r: f64 }\n"),
    "web/a.ts": ("typescript", "import { B } from './b';\nexport class A {\n  go(): void {\n    const b = new B();\n    b.stop();\n  }\n}\n"),
    "web/b.ts": ("typescript", "import { A } from './a';\nexport class B {\n  stop(): void {\n  }\n}\nexport const f = (x: number) => x;\n"),
    "G.java": ("java", "import x.y.Z;\npublic class G {\n  public int get() { return calc(1); }\n  int calc(int k) { return k; }\n}\n"),
    "m.go": ("go", 'package m\nimport (\n  "fmt"\n)\ntype T struct { a int }\ntype I interface { Do() }\nfunc (t *T) Do() { help(t) }\nfunc help(t *T) { fmt.Println(t) }\n'),
    "k.c": ("c", '#include "k.h"\nstatic int add(int a, int b) {\n  return a + b;\n}\nint main(void) { return add(1, 2); }\n'),
    "w.cpp": ("cpp", "class W {\npublic:\n  void run() {\n    step();\n  }\n  void step();\n};\nvoid W::step() { }\n"),
    "P.cs": ("csharp", "using System;\nnamespace N {\n  public class P {\n    public int Get() { return Calc(1); }\n    int Calc(int k) { return k; }\n  }\n}\n"),
    "r.rb": ("ruby", "require_relative 'q'\nclass R\n  def go(a)\n    b = a\n    helper\n    Q.new.run\n  end\n  def helper\n    1\n  end\nend\n"),
    "q.rb": ("ruby", "class Q\n  def run\n  end\nend\n"),
}
#: Annotated sites: (file, line, callee) to the qualified target, or none that must be found.
EXPECTED = {
    ("app/main.py", 6, "Store"): "Store@app/store.py", ("app/main.py", 7, "save"): "Store::save@app/store.py", ("app/main.py", 8, "helper"): "helper@app/main.py", ("app/main.py", 11, "norm"): "norm@app/util.py",
    ("app/store.py", 3, "_put"): "Store::_put@app/store.py", ("src/lib.rs", 5, "helper"): "Circle::helper@src/lib.rs", ("src/lib.rs", 7, "compute"): "compute@src/lib.rs", ("web/a.ts", 4, "B"): "B@web/b.ts", ("web/a.ts", 5, "stop"): "B::stop@web/b.ts",
    ("G.java", 3, "calc"): "G::calc@G.java", ("m.go", 7, "help"): "help@m.go", ("m.go", 8, "Println"): None, ("k.c", 5, "add"): "add@k.c", ("w.cpp", 4, "step"): "W::step@w.cpp", ("P.cs", 4, "Calc"): "P::Calc@P.cs", ("r.rb", 5, "helper"): "R::helper@r.rb", ("r.rb", 6, "run"): "Q::run@q.rb",
}
IMPORTS = {("app/main.py", "app.store"): "app/store.py", ("app/main.py", "app.util"): "app/util.py", ("src/lib.rs", "crate::shape::Circle"): "src/shape.rs", ("web/a.ts", "./b"): "web/b.ts", ("r.rb", "./q"): "q.rb", ("k.c", "k.h"): None, ("m.go", "fmt"): None, ("G.java", "x.y.Z"): None}
