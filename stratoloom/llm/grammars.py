"""EBNF grammars of the supported languages, for recognition only.

Operator precedence is left out on purpose: it does not change which texts are
valid.  A name in capitals is a token class of the lexer, a quoted string a
token spelled so; ``&nl`` holds where a line break or the end of the bracket
group stands before the next token, ``...`` is any balanced token
sequence, ``SEGMENT x END`` a statement that the lexer has folded up to its terminator.
"""

JSON = r"""
file = value ;
value = STR | NUM | 'true' | 'false' | 'null' | '{' ( pair ( ',' pair )* )? '}' | '[' ( value ( ',' value )* )? ']' ;
pair = STR ':' value ;
"""

GO = r"""
file = 'package' IDENT ';' ( import ';' )* ( top ';' )* ;
import = 'import' ( ispec | '(' ( ispec ( ';' ispec )* ';'? )? ')' ) ;
ispec = ( '.' | IDENT )? STR ;
top = decl | func ;
decl = 'const' ( cspec | '(' ( cspec ( ';' cspec )* ';'? )? ')' )
     | 'var' ( vspec | '(' ( vspec ( ';' vspec )* ';'? )? ')' )
     | 'type' ( tspec | '(' ( tspec ( ';' tspec )* ';'? )? ')' ) ;
cspec = ids ( type? '=' exprs )? ;
vspec = ids ( type ( '=' exprs )? | '=' exprs ) ;
tspec = IDENT tparams? '='? type ;
ids = IDENT ( ',' IDENT )* ;
tparams = '[' tparam ( ',' tparam )* ','? ']' ;
tparam = ids constraint ;
constraint = '~'? type ( '|' '~'? type )* ;
func = 'func' params? IDENT tparams? sig block? ;
sig = params ( params | type )? ;
params = '(' ( ( nparam ( ',' nparam )* | uparam ( ',' uparam )* ) ','? )? ')' ;
nparam = ids '\.\.\.'? type ;
uparam = '\.\.\.'? type ;
type = '*' type | '[' ']' type | '[' ( expr | '\.\.\.' ) ']' type | 'map' '[' type ']' type | 'chan' '<-'? type | '<-' 'chan' type
     | 'func' sig | 'struct' '{' field? ( ';' field? )* '}' | 'interface' '{' ielem? ( ';' ielem? )* '}'
     | IDENT ( '.' IDENT )? ( '[' types ']' )? | '(' type ')' ;
types = type ( ',' type )* ','? ;
field = ( ids type | '*'? IDENT ( '.' IDENT )? ( '[' types ']' )? ) STR? ;
ielem = IDENT sig | constraint ;
block = '{' stmts '}' ;
stmts = stmt? ( ';' stmt? )* ;
stmt = decl | IDENT ':' stmt? | simple | ( 'go' | 'defer' ) operand postfix* cargs | 'return' exprs? | 'break' IDENT? | 'continue' IDENT?
     | 'goto' IDENT | 'fallthrough' | block | if | switch | select | for ;
simple = expr ( ASSIGN expr | '++' | '--' | '<-' expr )? | exprs '=' exprs | ids ':=' exprs ;
if = 'if' ( simple? ';' )? expr block ( 'else' ( if | block ) )? ;
switch = 'switch' ( simple? ';' )? simple? '{' ( ( 'case' vals | 'default' ) ':' stmts )* '}' ;
select = 'select' '{' ( ( 'case' simple | 'default' ) ':' stmts )* '}' ;
for = 'for' ( expr? | simple? ';' expr? ';' simple? | ( exprs '=' | ids ':=' )? 'range' expr ) block ;
exprs = expr ( ',' expr )* ;
vals = val ( ',' val )* ;
val = expr | type ;
expr = unary ( ( OP | '+' | '-' | '*' | '&' | '^' | '|' | '<-' ) unary )* ;
unary = ( '+' | '-' | '!' | '^' | '*' | '&' | '<-' | '~' )* operand postfix* ;
operand = NUM | STR | CHAR | IDENT | '(' val ')' | 'func' sig block
     | littype '{' elems '}' | ( littype | 'chan' '<-'? type | 'interface' '{' ielem? ( ';' ielem? )* '}' | 'func' sig ) '(' expr ','? ')' ;
littype = '[' ']' type | '[' ( expr | '\.\.\.' ) ']' type | 'map' '[' type ']' type | 'struct' '{' field? ( ';' field? )* '}' ;
postfix = '.' IDENT | '.' '(' ( type | 'type' ) ')' | '[' ( vals ','? | expr? ':' expr? ( ':' expr )? ) ']'
     | cargs | '{' elems '}' ;
cargs = '(' ( vals '\.\.\.'? ','? )? ')' ;
elems = ( elem ( ',' elem )* ','? )? ;
elem = ( lit ':' )? lit ;
lit = expr | '{' elems '}' ;
"""

JAVA = r"""
file = ( mods 'package' qname ';' )? ( import | ';' )* ( typedecl | ';' )* ;
modular = import* annos 'open'? 'module' qname '{' directive* '}' ;
directive = ( 'requires' ( 'transitive' | 'static' )* qname | ( 'exports' | 'opens' ) qname ( 'to' qname ( ',' qname )* )?
     | 'uses' qname | 'provides' qname 'with' qname ( ',' qname )* ) ';' ;
import = 'import' 'static'? qname ( '.' '*' )? ';' ;
id = IDENT | 'record' | 'sealed' | 'permits' | 'var' | 'yield' | 'non' | 'module' | 'open' | 'with' | 'to' | 'requires'
     | 'exports' | 'opens' | 'uses' | 'provides' | 'transitive' ;
qname = id ( '.' id )* ;
anno = '@' qname ( '(' ( aval ( ',' aval )* )? ')' )? ;
annos = anno* ;
aval = ( id '=' )? aelem ;
aelem = expr | anno | '{' ( aelem ( ',' aelem )* )? ','? '}' ;
mods = ( anno | MOD | 'static' | 'final' | 'default' | 'synchronized' | 'sealed' | 'non' '-' 'sealed' )* ;
typedecl = mods ( class | iface | enum | record | annotype ) ;
class = 'class' id tparams? ( 'extends' type )? ( 'implements' types )? ( 'permits' types )? body ;
iface = 'interface' id tparams? ( 'extends' types )? ( 'permits' types )? body ;
enum = 'enum' id ( 'implements' types )? '{' ( const ( ',' const )* )? ','? ( ';' member* )? '}' ;
const = annos id args? body? ;
record = 'record' id tparams? '(' ( param ( ',' param )* )? ')' ( 'implements' types )? body ;
annotype = '@' 'interface' id body ;
body = '{' member* '}' ;
member = ';' | 'static'? block | typedecl
     | mods tparams? annos ( type | 'void' ) id params dims ( 'throws' types )? ( 'default' aelem )? ( block | ';' )
     | mods tparams? id params ( 'throws' types )? block | mods id block | mods type vars ';' ;
params = '(' ( param ( ',' param )* )? ')' ;
param = mods type annos '\.\.\.'? ( id dims | ( id '.' )* 'this' ) ;
dims = ( annos '[' ']' )* ;
vars = var ( ',' var )* ;
var = id dims ( '=' ( expr | init ) )? ;
init = '{' ( ( expr | init ) ( ',' ( expr | init ) )* )? ','? '}' ;
type = annos ( PRIM | id targs? ( '.' annos id targs? )* ) dims ;
types = type ( ',' type )* ;
targs = '<' ( targ ( ',' targ )* )? '>' ;
targ = type | annos '?' ( ( 'extends' | 'super' ) type )? ;
tparams = '<' tparam ( ',' tparam )* '>' ;
tparam = annos id ( 'extends' type ( '&' type )* )? ;
block = '{' bstmt* '}' ;
bstmt = mods type vars ';' | mods ( class | iface | enum | record ) | stmt ;
stmt = block | ';' | effect ';' | 'if' '(' expr ')' stmt ( 'else' stmt )? | 'while' '(' expr ')' stmt
     | 'do' stmt 'while' '(' expr ')' ';' | 'for' '(' forhead ')' stmt | 'return' expr? ';' | 'throw' expr ';'
     | 'break' id? ';' | 'continue' id? ';' | 'yield' expr ';' | try | switch | 'synchronized' '(' expr ')' block
     | 'assert' expr ( ':' expr )? ';' | id ':' stmt ;
forhead = ( mods type vars | effects )? ';' expr? ';' effects? | mods type id dims ':' expr ;
try = 'try' ( '(' res ( ';' res )* ';'? ')' block catch* ( 'finally' block )? | block ( catch+ ( 'finally' block )? | 'finally' block ) ) ;
res = mods type id '=' expr | expr ;
catch = 'catch' '(' mods type ( '|' type )* id ')' block ;
switch = 'switch' '(' expr ')' '{' ( ( label ':' )+ bstmt* )* '}' | 'switch' '(' expr ')' '{' ( label '->' ( expr ';' | block | 'throw' expr ';' ) )* '}' ;
label = 'case' item ( ',' item )* | 'default' ;
item = ternary | 'default' | mods type id ;
exprs = expr ( ',' expr )* ;
effects = effect ( ',' effect )* ;
effect = place aop expr | ( '++' | '--' ) place | place ( '++' | '--' ) | primary postfix* ( args | '.' 'new' creator ) | 'new' creator ;
expr = ternary | lambda | place aop expr ;
aop = '=' | ASSIGN | '>' '>=' | '>' '>' '>=' ;
place = id | '(' place ')' | primary postfix* ( '.' id | '[' expr ']' ) ;
ternary = unary rest* ( '?' expr ':' ( ternary | lambda ) )? ;
rest = ( OP | '+' | '-' | '*' | '&' | '|' | '<' | '>' | '>' '>' | '>' '>' '>' | '>=' ) unary | 'instanceof' mods type id? ;
lambda = ( id | '(' ( param ( ',' param )* | id ( ',' id )* )? ')' ) '->' ( expr | block ) ;
cast = '(' type ( '&' type )* ')' ;
unary = ( '+' | '-' | '!' | '~' | cast )* ( primary postfix* | place ( '++' | '--' ) | ( '++' | '--' ) place ) | cast lambda ;
primary = NUM | STR | CHAR | 'true' | 'false' | 'null' | id | 'this' | 'super' | '(' expr ')' | 'new' creator | switch
     | PRIM dims ( '.' 'class' | '::' 'new' ) | 'void' '.' 'class' ;
postfix = '.' ( id | 'class' | 'this' | 'super' | 'new' creator | targs ( id | 'super' ) | 'super' ) | args | '[' expr ']' | '[' ']'
     | '::' targs? ( id | 'new' ) | targs ( '.' id targs? )* dims '::' targs? ( id | 'new' ) ;
args = '(' exprs? ')' ;
creator = annos targs? annos ( PRIM | id targs? ( '.' annos id targs? )* ) ( ( annos '[' expr ']' )* dims init? | args body? ) ;
"""

JAVASCRIPT = r"""
file = HASHBANG? item* ;
item = import | export | stmt ;
id = IDENT | 'async' | 'of' | 'get' | 'set' | 'from' | 'as' | 'let' | 'static' | 'meta' | 'target' | 'yield' ;
eos = ';' | &nl ;
import = 'import' ( STR | ( id ( ',' ( '*' 'as' id | named ) )? | '*' 'as' id | named ) 'from' STR ) ( 'with' objlit )? eos ;
named = '{' ( spec ( ',' spec )* ','? )? '}' ;
spec = ( name | STR ) ( 'as' ( name | STR ) )? ;
export = 'export' ( 'default' ( function | class | assign eos ) | decl | '*' ( 'as' ( name | STR ) )? 'from' STR eos | named ( 'from' STR )? eos ) ;
decl = function | class | vars eos ;
vars = ( 'var' | 'let' ) vbind ( ',' vbind )* | 'const' init ( ',' init )* ;
vbind = id | init ;
init = target '=' assign ;
bind = target ( '=' assign )? ;
target = id | '{' ( tprop ( ',' tprop )* ','? )? '}' | '[' ','* ( telem ( ','+ telem )* ','* )? ']' ;
tprop = '\.\.\.' target | key ':' bind | id ( '=' assign )? ;
telem = '\.\.\.'? bind ;
function = 'async'? 'function' '*'? id? params block ;
params = '(' ( param ( ',' param )* ','? )? ')' ;
param = '\.\.\.'? bind ;
class = 'class' id? ( 'extends' lhs )? '{' member* '}' ;
member = ';' | 'static' block | 'static'? ( 'get' | 'set' | 'async' | 'async'? '*' )? key params block | 'static'? key ( '=' assign )? eos ;
key = name | STR | NUM | '[' assign ']' | PRIVATE ;
block = '{' stmt* '}' ;
stmt = block | decl | ';' | exprs eos | 'if' '(' exprs ')' stmt ( 'else' stmt )? | 'while' '(' exprs ')' stmt
     | 'do' stmt 'while' '(' exprs ')' ( ';' | ) | 'for' '(' ( forhead | ofhead ) ')' stmt | 'for' 'await' '(' ofhead ')' stmt | 'return' exprs? eos | 'throw' exprs eos
     | 'break' id? eos | 'continue' id? eos | 'debugger' eos | id ':' stmt
     | 'try' block ( 'catch' ( '(' target ')' )? block ( 'finally' block )? | 'finally' block )
     | 'switch' '(' exprs ')' '{' ( ( 'case' exprs | 'default' ) ':' stmt* )* '}' ;
forhead = ( vars | exprs )? ';' exprs? ';' exprs? | each 'in' exprs ;
ofhead = each 'of' assign ;
each = ( 'var' | 'let' | 'const' ) target | place ;
exprs = assign ( ',' assign )* ;
assign = binary ( '?' assign ':' assign )? | place '=' assign | ref ASSIGN assign | arrow | yield ;
binary = bits ( ( ( '||' | '&&' ) bits )* | ( '??' bits )+ ) ;
bits = operand ( ( OP | '+' | '-' | '*' | 'in' | 'instanceof' ) operand )* ;
operand = ( PRIVATE 'in' )? power ;
power = update ( '**' power )? | ( '+' | '-' | '!' | '~' | 'typeof' | 'void' | 'delete' | 'await' )+ update ;
update = lhs | ref ( '++' | '--' ) | ( '++' | '--' ) ref ;
ref = id | '(' ref ')' | 'new'* primary postfix* ( '.' ( name | PRIVATE ) | '[' exprs ']' ) ;
place = ref | '{' ( pprop ( ',' pprop )* ','? )? '}' | '[' ','* ( pelem ( ','+ pelem )* ','* )? ']' ;
pprop = '\.\.\.' ref | key ':' place ( '=' assign )? | id ( '=' assign )? ;
pelem = '\.\.\.'? place ( '=' assign )? ;
yield = 'yield' ( '*'? assign )? ;
arrow = 'async'? ( id | params ) '=>' ( block | assign ) ;
lhs = 'new'* primary ( postfix | chain )* ;
primary = id | NUM | STR | TEMPLATE | REGEX | 'true' | 'false' | 'null' | 'this' | 'super' | '(' exprs ','? ')' | arrlit | objlit
     | function | class | 'new' '.' 'target' | 'import' ( '.' 'meta' | '(' assign ( ',' assign )? ','? ')' ) ;
postfix = '.' ( name | PRIVATE ) | '[' exprs ']' | args | TEMPLATE ;
chain = '?.' ( name | PRIVATE | '[' exprs ']' | args | TEMPLATE ) ;
args = '(' ( '\.\.\.'? assign ( ',' '\.\.\.'? assign )* ','? )? ')' ;
arrlit = '[' ','* ( '\.\.\.'? assign ( ','+ '\.\.\.'? assign )* ','* )? ']' ;
objlit = '{' ( prop ( ',' prop )* ','? )? '}' ;
prop = '\.\.\.' assign | key ':' assign | id | ( 'get' | 'set' | 'async' | 'async'? '*' )? key params block ;
name = id | 'break' | 'case' | 'catch' | 'class' | 'const' | 'continue' | 'debugger' | 'default' | 'delete' | 'do' | 'else' | 'export'
     | 'extends' | 'finally' | 'for' | 'function' | 'if' | 'import' | 'in' | 'instanceof' | 'new' | 'return' | 'super' | 'switch' | 'this'
     | 'throw' | 'try' | 'typeof' | 'var' | 'void' | 'while' | 'with' | 'true' | 'false' | 'null' | 'await' | 'enum' ;
substitution = exprs ;
"""

PYTHON = r"""
file = stmt* ;
id = IDENT | 'match' | 'case' | 'type' ;
stmt = SEGMENT simple NL END | simple NL | compound ;
simple = small ( ';' small )* ';'? ;
small = assign | 'pass' | 'break' | 'continue' | 'return' items? | 'raise' ( expr ( 'from' expr )? )? | ( 'global' | 'nonlocal' ) id ( ',' id )*
     | 'del' place ( ',' place )* ','? | 'assert' expr ( ',' expr )? | import | 'type' id tparams? '=' expr ;
assign = items | yield | ( targets '=' )+ rhs | single ( AUG rhs | ':' expr ( '=' rhs )? ) ;
rhs = items | yield ;
yield = 'yield' ( items | 'from' expr )? ;
import = 'import' dotted ( 'as' id )? ( ',' dotted ( 'as' id )? )*
     | 'from' ( ( '.' | '\.\.\.' )+ dotted? | dotted ) 'import' ( '*' | names | '(' names ','? ')' ) ;
dotted = id ( '.' id )* ;
names = id ( 'as' id )? ( ',' id ( 'as' id )? )* ;
suite = simple NL | NL INDENT stmt+ DEDENT ;
compound = if | 'while' named ':' suite ( 'else' ':' suite )? | 'async'? for | 'async'? with
     | try | ( '@' named NL )* ( 'class' id tparams? args? ':' suite | 'async'? def )
     | 'match' items ':' NL INDENT ( 'case' pats ( 'if' named )? ':' suite )+ DEDENT ;
if = 'if' named ':' suite ( 'elif' named ':' suite )* ( 'else' ':' suite )? ;
for = 'for' targets 'in' items ':' suite ( 'else' ':' suite )? ;
with = 'with' ( withitem ( ',' withitem )* | '(' withitem ( ',' withitem )* ','? ')' ) ':' suite ;
withitem = expr ( 'as' place )? ;
try = 'try' ':' suite ( ( 'except' ( '*'? expr ( 'as' id )? )? ':' suite )+ ( 'else' ':' suite )? ( 'finally' ':' suite )? | 'finally' ':' suite ) ;
def = 'def' id tparams? '(' ( dplain ( ',' dstar )? ','? | dstar ','? )? ')' ( '->' expr )? ':' suite ;
dp = id ( ':' expr )? ;
dd = dp '=' expr ;
dplain = dp ( ',' dp )* ( ( ',' '/' ( ',' dp )* )? ( ',' dd )* | ( ',' dd )+ ',' '/' ( ',' dd )* ) | dd ( ',' dd )* ( ',' '/' ( ',' dd )* )? ;
dstar = ( '*' id ( ':' '*'? expr )? ( ',' dp ( '=' expr )? )* | '*' ( ',' dp ( '=' expr )? )+ ) ( ',' '**' dp )? | '**' dp ;
tparams = '[' tparam ( ',' tparam )* ','? ']' ;
tparam = ( '*' | '**' )? id ( ':' expr )? ( '=' '*'? expr )? ;
targets = '*'? place ( ',' '*'? place )* ','? ;
place = single | '(' targets? ')' | '[' targets? ']' ;
single = id | atom postfix* ( '.' id | '[' slice ( ',' slice )* ','? ']' ) | '(' single ')' ;
sum = unary ( ( '+' | '-' | '*' | '/' | '@' | '|' | '&' | '^' | OP ) unary )* ;
items = item ( ',' item )* ','? ;
item = '*' sum | named ;
named = id ':=' expr | expr ;
expr = 'lambda' lparams ':' expr | or ( 'if' or 'else' expr )? ;
lparams = ( lplain ( ',' lstar )? ','? | lstar ','? )? ;
ld = id '=' expr ;
lplain = id ( ',' id )* ( ( ',' '/' ( ',' id )* )? ( ',' ld )* | ( ',' ld )+ ',' '/' ( ',' ld )* ) | ld ( ',' ld )* ( ',' '/' ( ',' ld )* )? ;
lstar = ( '*' id ( ',' id ( '=' expr )? )* | '*' ( ',' id ( '=' expr )? )+ ) ( ',' '**' id )? | '**' id ;
or = not ( ( 'and' | 'or' ) not )* ;
not = 'not'* sum ( ( CMP | 'in' | 'not' 'in' | 'is' | 'is' 'not' ) sum )* ;
unary = ( '+' | '-' | '~' )* 'await'? atom postfix* ( '**' unary )? ;
postfix = '.' id | args | '[' slice ( ',' slice )* ','? ']' ;
slice = expr? ':' expr? ( ':' expr? )? | item ;
args = '(' ( ( plain ( ',' plain )* ( ',' keys )? | keys ) ','? | named comp )? ')' ;
plain = '*' expr | named ;
keys = id '=' expr ( ',' ( id '=' expr | '*' expr ) )* ( ',' more )? | more ;
more = '**' expr ( ',' ( id '=' expr | '**' expr ) )* ;
comp = ( 'async'? 'for' targets 'in' or ( 'if' cond )* )+ ;
cond = or | 'lambda' lparams ':' cond | id ':=' expr ;
atom = id | NUM | STR+ | 'True' | 'False' | 'None' | '\.\.\.' | '(' ( yield | items | item comp )? ')' | '[' ( items | item comp )? ']'
     | '{' ( ( pair ( ',' pair )* ','? ) | expr ':' expr comp | items | item comp )? '}' ;
pair = expr ':' expr | '**' sum ;
pats = pat ( ',' pat )* ','? ;
pat = '*' id | orpat ( 'as' id )? ;
orpat = apat ( '|' apat )* ;
apat = '-'? NUM ( ( '+' | '-' ) NUM )? | STR+ | 'True' | 'False' | 'None' | dotted ( '(' ( parg ( ',' parg )* ','? )? ')' )? | '(' pats? ')' | '[' pats? ']'
     | '{' ( ppair ( ',' ppair )* ','? )? '}' ;
parg = ( id '=' )? pat ;
ppair = orpat ':' pat | '**' id ;
field = '(' ( items | yield ) ')' NL ;
"""

RUST = r"""
file = innerattr* items ;
items = ( SEGMENT item+ END | item )* ;
id = IDENT | 'union' | 'auto' | 'raw' | 'macro_rules' | 'default' ;
innerattr = '#' '!' '[' ... ']' ;
attr = '#' '[' ... ']' ;
vis = 'pub' ( '(' ( 'crate' | 'self' | 'super' | 'in' path ) ')' )? ;
item = attr* vis? ( fn | struct | enum | trait | impl | use | const | static | alias | mod | extern ) | attr* macro ;
macro = path '!' id? ( '{' ... '}' | '(' ... ')' ';' | '[' ... ']' ';' ) ;
fn = ( 'default' | 'const' | 'async' | 'unsafe' | 'extern' STR? )* 'fn' id generics? '(' ( param ( ',' param )* ','? )? ')' ( '->' type )? where? ( block | ';' ) ;
param = attr* ( ( ( '&' | '&&' ) LIFETIME? )? 'mut'? 'self' ( ':' type )? | pat ':' type | '\.\.\.' ) ;
generics = '<' ( gparam ( ',' gparam )* ','? )? '>' ;
gparam = attr* ( LIFETIME ( ':' ( LIFETIME ( '+' LIFETIME )* )? )? | id ( ':' bounds? )? ( '=' type )? | 'const' id ':' type ( '=' carg )? ) ;
carg = '-'? lit | block | path ;
bounds = bound ( '+' bound )* '+'? ;
bound = LIFETIME | '?'? forlt? path | '(' '?'? forlt? path ')' ;
forlt = 'for' generics ;
where = 'where' ( wpred ( ',' wpred )* ','? )? ;
wpred = LIFETIME ':' bounds? | forlt? type ':' bounds? ;
struct = ( 'struct' | 'union' ) id generics? ( where? '{' fields '}' | tuple where? ';' | where? ';' ) ;
fields = ( field ( ',' field )* ','? )? ;
field = attr* vis? id ':' type ;
tuple = '(' ( attr* vis? type ( ',' attr* vis? type )* ','? )? ')' ;
enum = 'enum' id generics? where? '{' ( variant ( ',' variant )* ','? )? '}' ;
variant = attr* vis? id ( '{' fields '}' | tuple )? ( '=' expr )? ;
trait = ( 'unsafe' | 'auto' )* 'trait' id generics? ( ':' bounds? )? where? ( '{' innerattr* items '}' ) ;
impl = ( 'default' | 'unsafe' )* 'impl' generics? ( '!'? type 'for' )? type where? '{' innerattr* items '}' ;
use = 'use' tree ';' ;
tree = '::'? ( seg '::' )* ( seg ( 'as' ( id | '_' ) )? | '*' | '{' ( tree ( ',' tree )* ','? )? '}' ) ;
seg = id | 'self' | 'super' | 'crate' | 'Self' ;
const = 'const' ( id | '_' ) ':' type ( '=' expr )? ';' ;
static = 'static' 'mut'? id ':' type ( '=' expr )? ';' ;
alias = 'type' id generics? ( ':' bounds? )? where? ( '=' type )? where? ';' ;
mod = 'unsafe'? 'mod' id ( ';' | '{' innerattr* items '}' ) ;
extern = 'extern' 'crate' ( id | 'self' ) ( 'as' ( id | '_' ) )? ';' | 'unsafe'? 'extern' STR? '{' innerattr* items '}' ;
type = ( '&' | '&&' ) LIFETIME? 'mut'? type | '*' ( 'const' | 'mut' ) type | '[' type ( ';' expr )? ']' | '(' ( type ( ',' type )* ','? )? ')' | '!' | '_'
     | ( 'impl' | 'dyn' ) bounds | forlt? ( 'unsafe' | 'extern' STR? )* 'fn' '(' ( targ ( ',' targ )* ','? )? ')' ( '->' type )?
     | forlt? path | path '!' ( '(' ... ')' | '[' ... ']' | '{' ... '}' ) ;
targ = attr* ( ( id | '_' ) ':' )? type | '\.\.\.' ;
path = '::'? pseg ( '::' pseg )* | qself ( '::' pseg )+ ;
qself = '<' type ( 'as' path )? '>' ;
pseg = seg ( '::'? gargs | '(' ( type ( ',' type )* ','? )? ')' ( '->' type )? )? ;
gargs = '<' ( garg ( ',' garg )* ','? )? '>' ;
garg = LIFETIME | type | id gargs? ( '=' ( type | carg ) | ':' bounds ) | carg ;
epath = '::'? eseg ( '::' eseg )* | qself ( '::' eseg )+ ;
eseg = seg ( '::' gargs )? ;
block = '{' innerattr* ( SEGMENT stmt+ END | stmt )* expr? '}' ;
stmt = ';' | item | attr* ( let | expr ';' | blocky ) ;
let = 'let' pats ( ':' type )? ( '=' expr ( 'else' block )? )? ';' ;
expr = attr* set ;
set = span ( ( '=' | ASSIGN ) set )? ;
span = or ( ( '\.\.' | '\.\.=' ) or? )? | ( '\.\.' | '\.\.=' ) or? ;
or = and ( '||' and )* ;
and = compared ( '&&' compared )* ;
compared = bits ( ( CMP | '<' | '>' | '>=' ) bits )? ;
bits = unary ( ( OP | '+' | '-' | '*' | '&' | '|' | '>' '>' ) unary | 'as' type )* ;
unary = ( '-' | '!' | '*' | ( '&' | '&&' ) ( 'raw' ( 'const' | 'mut' ) )? 'mut'? )* primary postfix* ;
postfix = '?' | '.' ( id ( '::' gargs )? | NUM | 'await' ) | '(' args ')' | '[' expr ']' ;
args = ( expr ( ',' expr )* ','? )? ;
lit = NUM | STR | CHAR | 'true' | 'false' ;
primary = epath '{' inits '}' | plain ;
array = '[' ( args | expr ';' expr ) ']' ;
plain = lit | epath | '(' args ')' | array | blocky | closure | epath '!' ( '(' ... ')' | '[' ... ']' | '{' ... '}' )
     | 'return' expr? | 'break' LIFETIME? expr? | 'continue' LIFETIME? | 'let' pats '=' expr | '_' ;
inits = ( init ( ',' init )* ( ',' ( '\.\.' expr? )? )? | '\.\.' expr? )? ;
init = attr* ( id | NUM ) ( ':' expr )? ;
closure = ( 'static' | 'async' | 'move' )* ( '||' | '|' ( cparam ( ',' cparam )* ','? )? '|' ) ( '->' type block | expr ) ;
cparam = attr* pat ( ':' type )? ;
blocky = ( LIFETIME ':' )? block | ( 'unsafe' | 'const' | 'async' 'move'? ) block | if | match | ( LIFETIME ':' )? ( 'loop' block | 'while' head block | 'for' pats 'in' head block ) ;
if = 'if' head block ( 'else' ( if | block ) )? ;
match = 'match' head '{' innerattr* ( attr* pats ( 'if' expr )? '=>' ( expr ',' | blocky ','? ) )* ( attr* pats ( 'if' expr )? '=>' expr )? '}' ;
pats = '|'? pat ( '|' pat )* ;
pat = ( '&' | '&&' ) 'mut'? pat | 'ref'? 'mut'? id ( '@' pat )? | '_' | '\.\.' | range | '(' ( pats ( ',' pats )* ','? )? ')' | '[' ( pats ( ',' pats )* ','? )? ']'
     | epath ( '(' ( pats ( ',' pats )* ','? )? ')' | '{' ( fpat ( ',' fpat )* ','? )? '}' )? | epath '!' ( '(' ... ')' | '[' ... ']' | '{' ... '}' ) ;
range = pend ( ( '\.\.' | '\.\.=' | '\.\.\.' ) pend? )? | ( '\.\.=' | '\.\.' ) pend ;
pend = '-'? lit | epath ;
fpat = attr* ( '\.\.' | ( id | NUM ) ':' pats | 'ref'? 'mut'? id ) ;
"""


def _without_struct_literals(text: str) -> str:
    """The rules of expressions once more, for the heads of ``if``, ``while``, ``for`` and ``match``."""
    names = "expr set span or and compared bits unary primary plain".split()
    rules = {r.split(" = ", 1)[0].strip(): r.split(" = ", 1)[1] for r in text.split(" ;\n") if " = " in r}
    rules["primary"] = "plain"
    out = ["head = head_expr"]
    for name in names:
        body = " ".join(f"head_{w}" if w in names else f"head_{w[:-1]}{w[-1]}" if w[:-1] in names and w[-1] in "*+?" else w for w in rules[name].split())
        out.append(f"head_{name} = {body}")
    return text + " ;\n".join(out) + " ;\n"


RUST = _without_struct_literals(RUST)
