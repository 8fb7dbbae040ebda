"""Parsing-expression grammars of the languages whose files are checked, over canonical tokens.

``a`` is an identifier, ``0`` a number, ``"`` a string (also a character, template or regular expression), ``~nl~`` a line
end that may end a statement. Only grammar is described: names, types and repeated declarations are not checked.
"""

from __future__ import annotations

#: ECMAScript. Lines marked TS are replaced or added for TypeScript (see ``TYPESCRIPT``).
JAVASCRIPT = r"""
unit <- items END
items <- item*
item <- importdecl / exportdecl / stmt
block <- stmt*
nl <- '~nl~'*
eos <- ';' / '~nl~' / END / &'}'
stmt <- ';' / '~nl~' / tsdecl / decorated / {block} !assignop / ifs / fors / whiles / dos / switch / try / funcdecl / classdecl / vars eos / jump eos / label stmt / expr eos
ifs <- 'if' (|expr|) nl stmt (nl 'else' nl stmt)?
fors <- 'for' 'await'? (|forhead|) nl stmt
whiles <- 'while' (|expr|) nl stmt / 'with' (|expr|) nl stmt
dos <- 'do' nl stmt nl 'while' (|expr|) eos?
switch <- 'switch' (|expr|) nl {switchbody}
switchbody <- '~nl~'* (('case' expr / 'default') ':' stmt*)*
try <- 'try' nl {block} (catch finally? / finally)
catch <- nl 'catch' (|catchparam|)? nl {block}
catchparam <- target typeann?
finally <- nl 'finally' nl {block}
jump <- 'throw' expr / 'return' expr? / 'break' ID? / 'continue' ID? / 'debugger'
label <- ID ':'
vars <- ('const' / 'let' / 'var') var (',' var)*
var <- target '!'? typeann? ('=' assign)?
forhead <- ('const' / 'let' / 'var') target ('of' assign / 'in' expr) / (vars / expr)? ';' expr? ';' expr? / postfix ('of' assign / 'in' expr)
funcdecl <- 'async'? 'function' '*'? ID tparams? (|params|) rettype? nl ({block} / overload)
overload <- !'a' 'a'
classdecl <- 'abstract'? 'class' ID tparams? heritage {classbody}
heritage <- ('extends' postfix targs?)? ('implements' type (',' type)*)?
classbody <- (';' / '~nl~' / member)*
member <- 'static' {block} / decorator* modifier* (methodname tparams? (|params|) rettype? ({block} / overload) / key optional typeann? ('=' assign)? (';' / '~nl~' / END / &'}') / [indexsig] typeann)
modifier <- ('static' / 'async' / 'get' / 'set' / '*' / 'accessor' / tsmodifier) !('(' / '=' / ';' / '~nl~' / ',' / END / (|params|))
tsmodifier <- !'a' 'a'
methodname <- key optional
optional <- !'a' 'a' / nothing
nothing <-
key <- '#' NAME / NAME / STR / NUM / [expr]
decorator <- '@' postfix '~nl~'*
decorated <- decorator+ exportdecl / decorator+ classdecl
importdecl <- 'import' (STR / importwhat 'from' STR) withs? eos
importwhat <- tsonly? (ID (',' (star / {names}))? / star / {names})
tsonly <- !'a' 'a'
star <- '*' 'as' NAME
withs <- ('with' / 'assert') {objlit}
names <- '~nl~'* (spec (',' '~nl~'* spec)* ','?)? '~nl~'*
spec <- tsonly? (NAME / STR) ('as' (NAME / STR))?
exportdecl <- 'export' ('default' (funcanon / classanon / classdecl / tsdecl / assign eos) / ('*' ('as' NAME)? 'from' STR eos) / tsonly? {names} ('from' STR)? eos / tsdecl / funcdecl / classdecl / vars eos / '=' expr eos)
funcanon <- 'async'? 'function' '*'? ID? tparams? (|params|) rettype? {block}
classanon <- 'class' ID? tparams? heritage {classbody}
expr <- assign (',' assign)*
assign <- arrow / 'yield' '*'? assign? / cond (assignop assign)?
assignop <- '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '**=' / '<<=' / '&=' / '|=' / '^=' / '&&=' / '||=' / '??=' / '>' '>=' / '>' '>' '>='
arrow <- 'async'? tparams? (ID / (|params|) rettype?) '=>' ({block} / assign)
cond <- unary (binop unary)* ('?' assign ':' assign)?
binop <- '**' / '*' / '/' / '%' / '+' / '-' / '<<' / '>' '>' '>' / '>' '>' / '>=' / '<=' / '<' / '>' / '===' / '!==' / '==' / '!=' / '&&' / '||' / '??' / '&' / '|' / '^' / 'instanceof' / 'in' / tsas
tsas <- !'a' 'a'
unary <- ('!' / '~' / '+' / '-' / '++' / '--' / 'typeof' / 'void' / 'delete' / 'await')* postfix
postfix <- primary suffix* ('++' / '--')?
suffix <- '.' '#'? NAME / '?.' (NAME / (|args|) / [expr]) / (|args|) / [expr] / STR / tssuffix
tssuffix <- !'a' 'a'
args <- '~nl~'* (arg (',' arg)* ','?)? '~nl~'*
arg <- '...' assign / assign
primary <- funcanon / classanon / 'new' '.' NAME / 'new' postfix / ID / NUM / STR / 'this' / 'super' / 'null' / 'true' / 'false' / [elems] / {objlit} / (|expr|) / 'import' (|args|) / 'import' '.' NAME
elems <- (',' / arg ',')* arg? '~nl~'*
objlit <- '~nl~'* (prop (',' '~nl~'* prop)* ','?)? '~nl~'*
prop <- '...' assign / propmod* key tparams? (|params|) rettype? {block} / key ':' assign / ID ('=' assign)?
propmod <- ('get' / 'set' / 'async' / '*') !(':' / ',' / (|params|) / '=' / END)
params <- '~nl~'* (param (',' param)* ','?)? '~nl~'*
param <- decorator* tsmodifier* '...'? (target / 'this') optional typeann? ('=' assign)?
target <- ID / {pattern} / [elempattern]
pattern <- '~nl~'* (pprop (',' pprop)* ','?)? '~nl~'*
pprop <- '...' target / key ':' target ('=' assign)? / ID ('=' assign)?
elempattern <- (',' / elemtarget ',')* elemtarget?
elemtarget <- '...'? target ('=' assign)?
typeann <- !'a' 'a'
rettype <- !'a' 'a'
tparams <- !'a' 'a'
targs <- !'a' 'a'
type <- !'a' 'a'
indexsig <- !'a' 'a'
tsdecl <- !'a' 'a'
"""

#: What TypeScript adds: rules of these names replace those above.
TYPESCRIPT = r"""
overload <- eos
tsmodifier <- 'public' / 'private' / 'protected' / 'readonly' / 'abstract' / 'override' / 'declare'
optional <- ('?' / '!')?
tsonly <- 'type'
tsas <- !'a' 'a'
tssuffix <- '!' !'=' / 'as' 'const' / ('as' / 'satisfies') type / targs &(|args|)
typeann <- ':' type
rettype <- ':' ('asserts' ID ('is' type)? / (ID / 'this') 'is' type / type)
tparams <- '<' tparam (',' tparam)* ','? '>'
tparam <- 'const'? ('in' / 'out')? ID ('extends' type)? ('=' type)?
targs <- '<' type (',' type)* ','? '>'
type <- ('|' / '&')? tpost (('|' / '&') tpost)* ('extends' type '?' type ':' type)?
tpost <- tprim [tindex]*
tindex <- type?
tprim <- tparams? (|params|) '=>' (ID 'is' type / type) / 'new' tparams? (|params|) '=>' type / ('keyof' / 'readonly' / 'unique' / 'infer') tpost / 'typeof' ('import' (|args|) / ID / 'this') ('.' NAME)* targs? / 'import' (|args|) ('.' NAME)* targs? / ID ('.' NAME)* targs? / STR / '-'? NUM / 'null' / 'void' / 'true' / 'false' / 'this' / {typebody} / [tuple] / (|type|)
tuple <- '~nl~'* (telem (',' telem)* ','?)? '~nl~'*
telem <- '...'? (NAME '?'? ':')? type '?'?
typebody <- tsep* (tmember (tsep+ tmember)* tsep*)?
tsep <- ';' / ',' / '~nl~'
tmember <- '-'? 'readonly'? [mapped] ('+' / '-')? '?'? ':' type / ('get' / 'set')? key '?'? tparams? (|params|) rettype? / 'readonly'? key '?'? typeann? / 'new'? tparams? (|params|) rettype?
mapped <- ID ':' type / ID 'in' type ('as' type)?
indexsig <- ID ':' type
tsdecl <- 'declare' (tsdecl / funcdecl / classdecl / vars eos / ID ({block} / {modulebody})) / 'interface' ID tparams? ('extends' type (',' type)*)? {typebody} / 'type' ID tparams? '=' type eos / 'const'? 'enum' ID {enumbody} / ('namespace' / 'module') (ID ('.' NAME)* / STR) ({block} / {modulebody}) / 'abstract' classdecl / 'import' ID '=' postfix eos
modulebody <- item*
enumbody <- '~nl~'* ((NAME / STR) ('=' assign)? (',' '~nl~'* (NAME / STR) ('=' assign)?)* ','?)? '~nl~'*
"""

JAVA = r"""
unit <- package? import* typedecl* END
package <- annotation* 'package' qname ';'
import <- 'import' 'static'? ID ('.' ID)* ('.' '*')? ';'
qname <- ID ('.' ID)*
typedecl <- ';' / mods (classrest / interfacerest / enumrest / recordrest / annrest)
mods <- (annotation / 'public' / 'protected' / 'private' / 'static' / 'abstract' / 'final' / 'native' / 'synchronized' / 'transient' / 'volatile' / 'strictfp' / 'default' !(':' / '->') / 'sealed' &('class' / 'interface' / 'abstract' / 'public') / 'non' '-' 'sealed')*
annotation <- '@' !'interface' qname (|annargs|)?
annargs <- annpair (',' annpair)* / annvalue / empty
annpair <- ID '=' annvalue
annvalue <- annotation / {annlist} / cond
annlist <- (annvalue (',' annvalue)*)? ','?
classrest <- 'class' ID tparams? ('extends' type)? implements? permits? {classbody}
interfacerest <- 'interface' ID tparams? ('extends' types)? permits? {classbody}
enumrest <- 'enum' ID implements? {enumbody}
recordrest <- 'record' ID tparams? (|params|) implements? {classbody}
annrest <- '@' 'interface' ID {annbody}
annbody <- (mods (type ID (|empty|) ('default' annvalue)? ';' / type vars ';') / typedecl)*
implements <- 'implements' types
permits <- 'permits' types
types <- type (',' type)*
tparams <- '<' tparam (',' tparam)* '>'
tparam <- annotation* ID ('extends' type ('&' type)*)?
type <- annotation* (PRIM / ctype) ([empty])*
ctype <- ID targs? ('.' ID targs?)*
targs <- '<' (targ (',' targ)*)? '>'
targ <- annotation* ('?' (('extends' / 'super') type)? / type)
empty <-
classbody <- member*
member <- ';' / 'static'? {block} / mods (classrest / interfacerest / enumrest / recordrest / annrest / tparams? ID (|params|) throws? {block} / ID {block} / tparams? ('void' / type) ID (|params|) [empty]* throws? ({block} / 'default' annvalue ';' / ';') / type vars ';')
throws <- 'throws' types
params <- (param (',' param)*)?
param <- ('final' / annotation)* type '...'? ('this' / ID) [empty]*
enumbody <- (constant (',' constant)*)? ','? (';' member*)?
constant <- annotation* ID (|args|)? {classbody}?
vars <- var (',' var)*
var <- ID [empty]* ('=' init)?
init <- {arrayinit} / expr
arrayinit <- (init (',' init)*)? ','?
block <- stmt*
stmt <- ';' / {block} / 'if' (|expr|) stmt ('else' stmt)? / 'for' (|forhead|) stmt / 'while' (|expr|) stmt / 'do' stmt 'while' (|expr|) ';' / 'try' (|resources|)? {block} catch* ('finally' {block})? / switch / 'synchronized' (|expr|) {block} / 'return' expr? ';' / 'throw' expr ';' / 'break' ID? ';' / 'continue' ID? ';' / 'yield' expr ';' / 'assert' expr (':' expr)? ';' / label stmt / local ';' / localtype / effect ';'
effect <- expr
label <- ID ':' !':'
localtype <- ('final' / 'abstract' / 'static' / annotation)* (classrest / interfacerest / enumrest / recordrest)
local <- ('final' / annotation)* type vars
catch <- 'catch' (|catchparam|) {block}
catchparam <- ('final' / annotation)* type ('|' type)* ID
resources <- resource (';' resource)* ';'?
resource <- local / postfix
forhead <- ('final' / annotation)* type ID ':' expr / (local / exprs)? ';' expr? ';' exprs?
exprs <- expr (',' expr)*
switch <- 'switch' (|expr|) {switchbody}
switchbody <- (caselabel ('->' (expr ';' / {block} / 'throw' expr ';') / ':' stmt*))*
caselabel <- 'default' / 'case' caseitem (',' caseitem)* ('when' cond)?
caseitem <- 'default' / type ID / cond
expr <- lambda / cond (assignop expr)?
assignop <- '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>' '>=' / '>' '>' '>='
lambda <- (ID / (|lparams|)) '->' ({block} / expr)
lparams <- param (',' param)* / ID (',' ID)* / empty
cond <- binary ('?' (lambda / cond) ':' (lambda / cond))?
binary <- unary (binop unary / 'instanceof' 'final'? type ID? (|args|)?)*
binop <- '||' / '&&' / '==' / '!=' / '<=' / '>=' / '<<' / '>' '>' '>' / '>' '>' / '<' / '>' / '|' / '^' / '&' / '+' / '-' / '*' / '/' / '%'
unary <- ('+' / '-' / '++' / '--' / '!' / '~') unary / (|casttype|) (lambda / unary) / postfix
casttype <- type ('&' type)*
postfix <- primary suffix* ('++' / '--')?
suffix <- '.' targs? ID (|args|)? / '.' 'new' ID targs? (|args|) / '.' 'this' / '.' 'class' / '.' 'super' / [expr] / '::' targs? (ID / 'new')
args <- (expr (',' expr)*)?
primary <- STR / NUM / 'true' / 'false' / 'null' / 'this' (|args|)? / 'super' (|args|)? / 'new' creator / 'switch' (|expr|) {switchbody} / type '::' (ID / 'new') / PRIM [empty]* '.' 'class' / 'void' '.' 'class' / ID [empty]+ '.' 'class' / ID (|args|)? / (|expr|)
creator <- annotation* (PRIM / ctype) ([expr]+ [empty]* / [empty]+ {arrayinit} / (|args|) {classbody}?)
"""

GO = r"""
unit <- package ';' (import ';')* (decl ';')* END
package <- 'package' ID
import <- 'import' (importspec / (|importspecs|))
importspecs <- (importspec (';' importspec)*)? ';'?
importspec <- ('.' / ID)? STR
decl <- 'func' (|params|)? ID tparams? (|params|) result? {block}? / vardecl
vardecl <- 'const' (constspec / (|constspecs|)) / 'var' (varspec / (|varspecs|)) / 'type' (typespec / (|typespecs|))
constspecs <- (constspec (';' constspec)*)? ';'?
constspec <- names (type? '=' exprs)?
varspecs <- (varspec (';' varspec)*)? ';'?
varspec <- names (type ('=' exprs)? / '=' exprs)
typespecs <- (typespec (';' typespec)*)? ';'?
typespec <- ID tparams? '='? type
tparams <- [tparamlist] &('(' / '=' / 'struct' / 'interface' / ID / 'func' / 'map' / (|params|) / 'chan' / '*')
tparamlist <- names constraint (',' names constraint)* ','?
constraint <- '~'? type ('|' '~'? type)*
names <- ID (',' ID)*
type <- 'struct' {fields} / 'interface' {methods} / 'map' [type] type / 'chan' '<-'? type / '<-' 'chan' type / 'func' (|params|) result? / '*' type / [arraylen] type / (|type|) / ID ('.' ID)? [types]?
types <- type (',' type)*
arraylen <- ('...' / expr)?
fields <- (field (';' field)*)? ';'?
field <- (names type / '*'? ID ('.' ID)? [types]?) STR?
methods <- (method (';' method)*)? ';'?
method <- ID (|params|) result? / constraint
params <- (param (',' param)* ','?)?
param <- ID '...'? type / '...'? type
result <- (|params|) / type
block <- stmt? (';' stmt?)*
stmt <- vardecl / 'func' ID / ID ':' stmt? / 'go' expr / 'defer' expr / 'return' exprs? / 'break' ID? / 'continue' ID? / 'goto' ID / 'fallthrough' / {block} / if / 'for' forhead? {block} / 'switch' switchhead? {cases} / 'select' {comms} / simple
if <- 'if' (hsimple ';')? hexpr {block} ('else' (if / {block}))?
forhead <- (hnames (':=' / '='))? 'range' hexpr / hsimple? ';' hexpr? ';' hsimple? / hexpr
hnames <- hexpr (',' hexpr)*
switchhead <- (hsimple? ';')? hguard? 
hguard <- ID ':=' hpostfix / hexpr
cases <- (('case' casetypes / 'default') ':' block)*
casetypes <- caseitem (',' caseitem)*
caseitem <- expr / type
comms <- (('case' simple / 'default') ':' block)*
simple <- exprs ((':=' / assignop) exprs / '<-' expr / '++' / '--')?
hsimple <- hexprs ((':=' / assignop) hexprs / '<-' hexpr / '++' / '--')?
assignop <- '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>>=' / '&^='
exprs <- expr (',' expr)*
hexprs <- hexpr (',' hexpr)*
expr <- unary (binop unary)*
hexpr <- hunary (binop hunary)*
binop <- '||' / '&&' / '==' / '!=' / '<=' / '>=' / '<<' / '>>' / '&^' / '<' / '>' / '+' / '-' / '|' / '^' / '*' / '/' / '%' / '&'
unop <- '+' / '-' / '!' / '^' / '*' / '&' / '<-'
unary <- unop* postfix
hunary <- unop* hpostfix
postfix <- primary suffix*
hpostfix <- hprimary hsuffix*
suffix <- '.' ID / '.' (|assertion|) / [index] / (|args|) / {composite}
hsuffix <- '.' ID / '.' (|assertion|) / [index] / (|args|)
assertion <- 'type' / type
index <- expr? ':' expr? (':' expr)? / types ','? / expr
args <- (arg (',' arg)* ','?)?
arg <- (expr / type) '...'?
primary <- NUM / STR / 'func' (|params|) result? {block} / ctype {composite} / ctype &(|args|) / (|grouped|) / ID
hprimary <- NUM / STR / 'func' (|params|) result? {block} / ctype {composite} / ctype &(|args|) / (|grouped|) / ID
grouped <- expr / type
ctype <- 'map' [type] type / [arraylen] type / 'struct' {fields} / 'chan' type / 'interface' {methods}
composite <- (elem (',' elem)* ','?)?
elem <- (({composite} / expr) ':')? ({composite} / expr)
"""

C = r"""
unit <- externals END
externals <- external*
external <- ';' / function / declaration / ID (|anything|) ';'?
function <- specs declarator knr* {block}
knr <- declaration
declaration <- 'typedef'? specs (initdecl (',' initdecl)*)? attr* ';' / '_Static_assert' (|args|) ';'
specs <- (qual / attr)* ('struct' / 'union') attr* (ID? {members} / ID) qual* / qual* 'enum' (ID? {enumerators} / ID) qual* / (qual / attr)* (BUILTIN qual*)+ / (qual / attr)* ID qual*
qual <- 'static' / 'extern' / 'const' / 'volatile' / 'inline' / 'register' / 'restrict' / 'auto' / '_Noreturn' / '_Thread_local' / '_Atomic'
attr <- '__attribute__' (|anything|)
anything <- (!END !')' any)*
any <- ANY
members <- member*
member <- ';' / specs (fielddecl (',' fielddecl)*)? ';'
fielddecl <- declarator (':' cond)? / ':' cond
enumerators <- (enumerator (',' enumerator)*)? ','?
enumerator <- ID ('=' cond)?
initdecl <- declarator attr* ('=' init)?
declarator <- ('*' qual*)* (ID / (|declarator|)) ((|params|) / [dim])*
abstract <- ('*' qual*)* (|abstract|)? ((|params|) / [dim])*
dim <- qual* cond?
params <- (param (',' param)* (',' '...')?)? / ID (',' ID)*
param <- specs (declarator / abstract) / '...'
init <- {initlist} / assign
initlist <- (initelem (',' initelem)*)? ','?
initelem <- (('.' ID / [expr])+ '=')? init
block <- stmt*
stmt <- ';' / {block} / 'if' (|expr|) stmt ('else' stmt)? / 'for' (|forhead|) stmt / 'while' (|expr|) stmt / 'do' stmt 'while' (|expr|) ';' / 'switch' (|expr|) stmt / 'case' cond ('...' cond)? ':' / 'default' ':' / 'return' expr? ';' / 'break' ';' / 'continue' ';' / 'goto' ID ';' / ID ':' / declaration / expr ';'
forhead <- (declaration / expr? ';') expr? ';' expr?
expr <- assign (',' assign)*
assign <- cond (assignop assign)?
assignop <- '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>>='
cond <- binary ('?' expr? ':' cond)?
binary <- unary (binop unary)*
binop <- '||' / '&&' / '==' / '!=' / '<=' / '>=' / '<<' / '>>' / '<' / '>' / '|' / '^' / '&' / '+' / '-' / '*' / '/' / '%'
unary <- ('++' / '--' / '&&' / '&' / '*' / '+' / '-' / '~' / '!') unary / 'sizeof' ((|typename|) / unary) / (|typename|) ({initlist} / unary) / postfix
typename <- specs abstract
postfix <- primary ([expr] / (|args|) / '.' ID / '->' ID / '++' / '--')*
args <- (argument (',' argument)*)?
argument <- assign / typename
primary <- ID / NUM / STR+ / (|expr|) / (|stmtexpr|)
stmtexpr <- {block}
"""

#: One logical line of Python; ``unit`` runs over kinds of lines (see ``syntax.py``).
PYTHON = r"""
simple <- small (';' small)* ';'? END
small <- 'pass' / 'break' / 'continue' / 'return' exprs? / 'raise' (test ('from' test)?)? / 'del' targets / 'global' names / 'nonlocal' names / 'assert' test (',' test)? / import / 'type' ID tparams? '=' test / assignment
names <- ID (',' ID)*
targets <- starred (',' starred)* ','?
import <- 'import' dotted ('as' ID)? (',' dotted ('as' ID)?)* / 'from' ('.' / '...')* dotted? 'import' ('*' / importnames / (|importparen|))
importparen <- importnames ','?
importnames <- ID ('as' ID)? (',' ID ('as' ID)?)*
dotted <- ID ('.' ID)*
assignment <- aim augassign (yield / exprs) / aim ':' test ('=' (yield / exprs))? / (aims '=')* (yield / exprs)
aims <- aimitem (',' aimitem)* ','?
aimitem <- '*'? aim
aim <- atom (trailer &trailer)* settrailer !trailer / ID !trailer / (|tuple|) !trailer / [list] !trailer
settrailer <- '.' ID / [subscript]
augassign <- '+=' / '-=' / '*=' / '/=' / '//=' / '%=' / '@=' / '&=' / '|=' / '^=' / '>>=' / '<<=' / '**='
yield <- 'yield' ('from' test / exprs)?
exprs <- starred (',' starred)* ','?
starred <- '*' or / named
named <- ID ':=' test / test
test <- 'lambda' lambdaparams? ':' test / ortest ('if' ortest 'else' test)?
ortest <- andtest ('or' andtest)*
andtest <- nottest ('and' nottest)*
nottest <- 'not' nottest / comparison
comparison <- or (('<' / '>' / '==' / '>=' / '<=' / '!=' / 'not' 'in' / 'in' / 'is' 'not' / 'is') or)*
or <- factor (('|' / '^' / '&' / '<<' / '>>' / '+' / '-' / '*' / '@' / '//' / '/' / '%') factor)*
factor <- ('+' / '-' / '~') factor / power
power <- 'await'? atom trailer* ('**' factor)?
trailer <- '.' ID / (|args|) / [subscript]
subscript <- slice (',' slice)* ','?
slice <- named? ':' test? (':' test?)? / starred
args <- ((arg (',' arg)*)? ','? / named compfor) END / ((arg (',' arg)*)? ','? / named compfor) &')'
arg <- '**' test / '*' test / ID '=' test / named compfor? 
compfor <- 'async'? 'for' targetlist 'in' ortest ('if' nocond)* compfor?
nocond <- ID ':=' test / ortest
targetlist <- targetitem (',' targetitem)* ','?
targetitem <- '*'? or
atom <- ID / NUM / STR+ / 'None' / 'True' / 'False' / '...' / (|tuple|) / [list] / {dict}
tuple <- (yield / starred compfor / exprs)?
list <- (starred compfor / exprs)?
dict <- (dictitem compfor / starred compfor / dictitem (',' dictitem)* ','? / exprs)?
dictitem <- '**' or / test ':' test
lambdaparams <- lparam (',' lparam)* ','?
lparam <- '**' ID / '*' ID? / '/' / ID ('=' test)?
tparams <- [tparamlist]
tparamlist <- tparam (',' tparam)* ','?
tparam <- ('**' / '*')? ID (':' test)? ('=' test)?
params <- (param (',' param)* ','?)?
param <- '**' ID annotation? / '*' (ID (':' starred)?)? / '/' / ID annotation? ('=' test)?
annotation <- ':' test
inline <- simple / END
h_if <- 'if' named ':' inline
h_elif <- 'elif' named ':' inline
h_else <- 'else' ':' inline
h_while <- 'while' named ':' inline
h_for <- 'async'? 'for' targetlist 'in' exprs ':' inline
h_try <- 'try' ':' inline
h_except <- 'except' '*'? (exprs ('as' ID)?)? ':' inline
h_finally <- 'finally' ':' inline
h_with <- 'async'? 'with' ((|withitems|) ':' / withitem (',' withitem)* ':') inline
withitems <- withitem (',' withitem)* ','?
withitem <- test ('as' or)?
h_def <- 'async'? 'def' ID tparams? (|params|) ('->' exprs)? ':' inline
h_class <- 'class' ID tparams? (|args|)? ':' inline
h_match <- 'match' exprs ':' END
h_case <- 'case' pattern ('if' named)? ':' inline
pattern <- patitem (',' patitem)* ','?
patitem <- '*'? or ('as' ID)?
h_decorator <- '@' named END
"""

JSON = r"""
unit <- value END
value <- {object} / [array] / STR / NUM / 'true' / 'false' / 'null'
object <- (pair (',' pair)*)?
pair <- STR ':' value
array <- (value (',' value)*)?
"""
